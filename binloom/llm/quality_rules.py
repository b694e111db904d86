"""Quality rules by weak supervision, in DataFrame expressions only.

Seven rules look at a document and vote good (2), bad (0) or abstain (1). Expectation-maximisation over the histogram
of vote patterns (at most 3**7 rows, however many documents) estimates each rule's accuracy on good and on bad
documents; a document is kept if the posterior probability of good, given its votes, is at least ``KEEP``.

Results in odd cases: a null text counts as an empty one; it has no words, fails the base rules and isn't kept. Repeated
rows and repeated ids each give a row of their own with equal values. An empty table gives no rows. A null ``doc_id``
stays null. Further columns of the input, whatever their names, are ignored by ``judge`` and returned by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, own_columns, stored

WINDOW = 5
#: A word that is a mark by itself or ends in two marks.
MARKED = r"(?:[!?#*$%&|<>]{2,}|(?<![^\x20\x09-\x0D])[#*$%&|<>])(?=[\x20\x09-\x0D]|\z)"
KEEP = 0.5
ROUNDS = 40
#: Names of the rules, in the order of their votes.
RULES = ("length", "word_length", "symbols", "duplicate_lines", "repeated_words", "letter_case", "closing_marks")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marked")


def _twins(rows: Column, *same: str) -> Column:
    """Of sorted rows those that agree with a neighbour."""

    def like(x: Column, k: Column) -> Column:
        beside = lambda step: F.coalesce(sum((F.when(F.get(rows, k + step)[c] == x[c], 0).otherwise(1) for c in same), F.lit(0)) == 0, F.lit(False))
        return beside(-1) | beside(1)

    return F.filter(rows, like)


def _repeat_words(w: Column, h: Column) -> Column:
    """Words inside windows of five words ``w`` that occur twice or more. Hashes ``h`` only rule windows out: those left are compared as words."""
    at = F.transform(h, lambda x, k: F.struct(x.alias("h"), (k + 1).alias("i")))
    near = let(F.array_sort(at), lambda s: _twins(s, "h"))
    exact = let(
        near,
        lambda x: let(
            F.array_sort(F.transform(x, lambda r: F.struct(r["h"].alias("h"), F.slice(w, r["i"], WINDOW).alias("w"), r["i"].alias("i")))),
            lambda s: let(
                F.array_sort(F.transform(_twins(s, "h", "w"), lambda r: r["i"])),
                # each repeated window adds what reaches beyond the one before it
                lambda p: F.aggregate(p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"],
            ),
        ),
    )
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact)


def features(docs: DataFrame) -> DataFrame:
    """STATS of each row, over the whole text; the row itself is in the struct ``row``.

    Each text is split once, each word hashed once, and a window's hash made of its words' five.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.slice("hashes", 1, F.greatest(F.lit(0), F.size("hashes") - (WINDOW - 1)))
    rows = rows.withColumn("windows", F.transform(starts, lambda h, k: F.xxhash64(h, *[F.get("hashes", k + j) for j in range(1, WINDOW)])))
    return rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Ll}+", ""))).cast("long").alias("n_lower"),
        F.regexp_count("text", F.lit(MARKED)).cast("long").alias("n_marked"),
    )


def _votes() -> list[Column]:
    """0 bad, 1 abstains, 2 good."""
    c = F.col
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    dup, rep = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), per_word("n_repeat_words")
    upper = c("n_upper") / F.greatest(c("n_upper") + c("n_lower"), F.lit(1))
    marked = per_word("n_marked")
    vote = lambda bad, good: F.when(bad, F.lit(0)).when(good, F.lit(2)).otherwise(F.lit(1))
    return [
        vote(c("n_words") < 10, c("n_words") >= 30),
        vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.03),
        vote(dup > 0.3, dup < 0.1),
        vote(rep > 0.15, rep < 0.05),
        vote(upper > 0.4, upper < 0.2),
        vote(marked > 0.1, marked < 0.03),
    ]


def fit(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, p_good) for every vote pattern in ``votes(pattern)``: EM over the pattern histogram, as one expression.

    A rule has two accuracies: of its votes on good documents (at least 0.7), and of its votes on bad ones, which most
    kinds of bad document pass. The second stays over one less the first, so a rule never turns against its meaning;
    abstaining says nothing about a document.
    """
    k = len(RULES)
    hist = votes.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = hist.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("rows"))
    digits = lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.pmod(F.floor(p / F.pow(F.lit(3.0), j)), F.lit(3)).cast("int"))
    one = one.select(F.transform("rows", lambda r: F.struct(r["pattern"].alias("p"), r["n"].alias("n"), digits(r["pattern"]).alias("v"))).alias("rows"))

    def odds(v: Column, s: Column) -> Column:
        """log of good : bad"""
        of = lambda x: F.when(x["v"] == 2, F.log(x["g"]) - F.log1p(-x["b"])).when(x["v"] == 0, F.log1p(-x["g"]) - F.log(x["b"])).otherwise(F.lit(0.0))
        terms = F.arrays_zip(v.alias("v"), s["g"].alias("g"), s["b"].alias("b"))
        return F.aggregate(terms, F.log(s["pi"]) - F.log1p(-s["pi"]), lambda a, x: a + of(x))

    def posterior(v: Column, s: Column) -> Column:
        return 1 / (1 + F.exp(-odds(v, s)))

    def step(s: Column, rows: Column) -> Column:
        seen = F.transform(rows, lambda r: F.struct(r["n"].alias("n"), r["v"].alias("v"), posterior(r["v"], s).alias("q")))

        def again(m: Column) -> Column:
            total = lambda f: F.aggregate(m, F.lit(0.0), lambda a, r: a + f(r))
            share = lambda weight, want, j: (total(lambda r: F.when(r["v"][j] == want, weight(r)).otherwise(F.lit(0.0))) + 4) / (total(lambda r: F.when(r["v"][j] != 1, weight(r)).otherwise(F.lit(0.0))) + 5)
            held = lambda x, low: F.least(F.lit(0.995), F.greatest(low, x))
            good, bad = (lambda r: r["n"] * r["q"]), (lambda r: r["n"] * (1 - r["q"]))
            js = F.array(*[F.lit(j) for j in range(k)])
            pi = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (total(good) + 4) / (total(lambda r: r["n"]) + 5)))
            return let(F.transform(js, lambda j: held(share(good, 2, j), F.lit(0.7))), lambda g: F.struct(pi.alias("pi"), g.alias("g"), F.transform(js, lambda j: held(share(bad, 0, j), 1.05 - g[j])).alias("b")))

        return let(seen, again)

    first = F.struct(F.lit(0.8).alias("pi"), F.array(*[F.lit(0.95)] * k).alias("g"), F.array(*[F.lit(0.4)] * k).alias("b"))
    fitted = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda s, _: step(s, F.col("rows"))).alias("s"))
    return fitted.select(F.explode(F.transform("rows", lambda r: F.struct(r["p"].alias("pattern"), posterior(r["v"], F.col("s")).alias("p_good")))).alias("x")).select("x.*")


def _judged(docs: DataFrame) -> DataFrame:
    pattern = sum((v * 3**j for j, v in enumerate(_votes())), F.lit(0))
    seen = stored(features(docs).withColumn("pattern", pattern.cast("int")), "rules")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # at most 3**7 patterns, so that side is small whatever the input
    judged = seen.join(F.broadcast(fit(seen)), "pattern")
    return judged.withColumns({"base_failed": base, "kept": ~base & (F.col("p_good") >= KEEP)})


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, p_good, kept of each row of ``docs``."""
    return _judged(own_columns(docs, "doc_id", "text")).select("row.doc_id", *STATS, "base_failed", "p_good", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep."""
    return _judged(docs).where("kept").select("row.*")


def _rules_sql() -> str:
    """The rules and their fit as SQL, by lists instead of expressions over columns."""
    share = lambda weight, want: f"(list_sum(list_transform(rows, lambda r, i: CASE WHEN r.v[j] = {want} THEN {weight} ELSE 0 END)) + 4) / (list_sum(list_transform(rows, lambda r, i: CASE WHEN r.v[j] <> 1 THEN {weight} ELSE 0 END)) + 5)"
    odds = "ln(pi) - ln(1 - pi) + list_sum(list_transform(range(1, 8), lambda j: CASE r.v[j] WHEN 2 THEN ln(g[j]) - ln(1 - b[j]) WHEN 0 THEN ln(1 - g[j]) - ln(b[j]) ELSE 0 END))"
    votes = {
        "n_words": ("n_words < 10", "n_words >= 30"),
        "mean": ("mean < 2.5 OR mean > 12", "mean >= 3 AND mean <= 10"),
        "symbols": ("symbols > 0.1", "symbols < 0.03"),
        "dup": ("dup > 0.3", "dup < 0.1"),
        "rep": ("rep > 0.15", "rep < 0.05"),
        "upper": ("upper_ > 0.4", "upper_ < 0.2"),
        "marked": ("marked > 0.1", "marked < 0.03"),
    }
    v = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END" for bad, good in votes.values())
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1) GROUP BY rid),
f AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '\\P{{Ll}}', '', 'g')) AS n_lower,
      len(list_filter(ws, lambda x: regexp_matches(x, '[!?#*$%&|<>]{{2}}$') OR regexp_full_match(x, '[#*$%&|<>]'))) AS n_marked FROM w LEFT JOIN rep USING (rid)),
s AS (SELECT *, word_chars / greatest(n_words, 1) AS mean, n_symbols / greatest(n_words, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup, n_repeat_words / greatest(n_words, 1) AS rep,
      n_upper / greatest(n_upper + n_lower, 1) AS upper_, n_marked / greatest(n_words, 1) AS marked FROM f),
p AS (SELECT *, [{v}] AS v FROM s),
h AS (SELECT list({{'n': n, 'v': v}} ORDER BY v) AS rows FROM (SELECT v, count(*)::DOUBLE AS n FROM p GROUP BY v)),
em AS (
  SELECT 0 AS it, 0.8::DOUBLE AS pi, list_transform(range(7), lambda j: 0.95::DOUBLE) AS g, list_transform(range(7), lambda j: 0.4::DOUBLE) AS b
  UNION ALL
  SELECT it + 1, pi, g, list_transform(range(1, 8), lambda j: least(0.995, greatest(1.05 - g[j], {share('r.n * (1 - q[i])', 0)}))) AS b
  FROM (SELECT it, rows, q, least(0.99, greatest(0.01, (list_sum(list_transform(rows, lambda r, i: r.n * q[i])) + 4) / (list_sum(list_transform(rows, lambda r: r.n)) + 5))) AS pi,
               list_transform(range(1, 8), lambda j: least(0.995, greatest(0.7, {share('r.n * q[i]', 2)}))) AS g
        FROM (SELECT it, rows, list_transform(rows, lambda r: 1 / (1 + exp(-({odds})))) AS q FROM em, h WHERE it < {ROUNDS}))),
fitted AS (SELECT r.v AS v, 1 / (1 + exp(-({odds}))) AS p_good FROM (SELECT pi, g, b, unnest(rows) AS r FROM em, h WHERE it = {ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND p_good >= {KEEP} AS kept, round(p_good, 6) AS p_good
FROM p JOIN fitted USING (v)
"""


ORACLE = _rules_sql()
