"""Language of web pages by Bayesian evidence fusion.

log P(language | page) is, up to a constant, the sum of four terms: the likelihood of the visible text under byte trigram models, of the
declared markup language (``lang`` or ``xml:lang`` of the html tag, else a content-language tag), of the address suffix, and a prior of the host. The last two come from grouped
aggregations over all pages: expected counts of languages (by text and declaration) for each host, domain, suffix and over all. The
suffix term is log P(language | suffix) - log P(language); the prior's host is smoothed by its domain and that by all pages,
each level with ``SMOOTH`` pseudo-counts of the one above; a page's own counts are left out of its suffix term and prior.

The text models are fitted on the ``SAMPLE`` documents of least hash of each language (a documented bound, the same
at every size, so rare languages have models too; rows that share an id, the null one too, count once a language and take one place), a language to a
task; they have a fixed size for each language and are broadcast. Counts of a host are aggregated
before the shuffle and joined as one row a host; hosts with many pages are joined by broadcast.

Odd cases: a null or blank html has no text and relies on the other evidence; unclosed tags, comments and scripts are removed
without what follows; a null url has the empty host. A null
``page_id`` stays null. Repeated pages give a row each. No pages, no rows; without any labelled documents the language is null. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BIN, STR, join_hot, own_columns, schema, stored

SAMPLE, BUCKETS, SMOOTH = 1000, 1 << 16, 2.0
#: Trigrams overlap, so a text's log-likelihood counts for less, and no more than for this many trigrams (the mean over all of
#: them is weighed; at sf0.1 the declared language is met by 0.9988 with this bound and 0.9984 without, that of held-out documents by 0.9995 either way).
TEMPER, MOST_GRAMS = 0.3, 200.0
#: Chance that a declared language is right.
DECLARED = 0.8
_ENTITY = re.compile(rb"&[A-Za-z#0-9]+;")
_LANG = re.compile(rb"(?i)[\s\"'](?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,8})(?![a-z])")
_CONTENT = re.compile(rb"(?i)\scontent\s*=\s*[\"']?\s*([a-z]{2,8})(?![a-z])")
#: Three-letter codes of languages that have one of two letters.
CODES = {"deu": "de", "ger": "de", "eng": "en", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "ell": "el", "gre": "el", "tur": "tr", "ukr": "uk", "ces": "cs", "cze": "cs", "swe": "sv", "dan": "da", "fin": "fi", "hun": "hu", "ron": "ro", "rum": "ro", "zho": "zh", "chi": "zh", "jpn": "ja", "kor": "ko", "ara": "ar", "heb": "he", "hin": "hi", "vie": "vi"}
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_RUNS = re.compile(rb" {2,}")


def visible(html: bytes) -> bytes:
    """The text outside tags, comments, scripts and styles, in one pass: what isn't closed is looked for once."""
    low, out, at, closed = html.lower(), [], 0, {}

    def find(mark: bytes, start: int) -> int:
        if closed.get(mark) == -1:
            return -1
        closed[mark] = html.find(mark, start) if mark in (b">", b"<", b"-->") else low.find(mark, start)
        return closed[mark]

    while (tag := find(b"<", at)) >= 0:
        out.append(html[at:tag])
        end = -1
        if low.startswith(b"<!--", tag):
            end = find(b"-->", tag + 4)
            end += 2 if end >= 0 else 0
        elif low.startswith((b"<script", b"<style"), tag):
            end = find(b"</script" if low[tag + 2] == 99 else b"</style", tag)
            end = find(b">", end) if end >= 0 else -1
        if end < 0:
            end = find(b">", tag)
        if end < 0:  # no tag is closed from here on
            out.append(html[tag:].replace(b"<", b" "))
            break
        at = end + 1
    else:
        out.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def declared(html: bytes) -> str:
    """The language that the markup declares, or an empty string."""
    low = html.lower()
    for start, pattern in ((b"<html", _LANG), (b"content-language", _CONTENT), (b"<body", _LANG)):
        if (at := low.find(start)) >= 0:
            begin = low.rfind(b"<", 0, at + 1)
            end = low.find(b">", at)
            if found := pattern.search(low, begin, end if end >= 0 else at + 1000):
                code = found[1].decode()
                return CODES.get(code, code)
    return ""


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of folded texts, and how many each has."""
    clean = [b" " + _RUNS.sub(b" ", t.translate(_FOLD)).strip() + b" " for t in texts]
    sizes = np.array([max(0, len(t) - 2) for t in clean], np.int64)
    parts = []
    for t in clean:
        a = np.frombuffer(t, np.uint8).astype(np.uint32)
        parts.append(((a[:-2] * np.uint32(961748941) + a[1:-1] * np.uint32(29996224) + a[2:] * np.uint32(2654435761)) >> np.uint32(8)) & np.uint32(BUCKETS - 1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            grams, _ = _grams([text or b""])
            counts.setdefault(lang, np.zeros(BUCKETS))
            counts[lang] += np.bincount(grams, minlength=BUCKETS)
    for lang, c in counts.items():
        model = np.log((c + 0.1) / (c.sum() + 0.1 * BUCKETS)).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([model])], ["lang", "model"])


def fit(docs: DataFrame) -> dict[str, bytes]:
    own = own_columns(docs, "doc_id", "text", "lang").select(F.xxhash64("doc_id").alias("h"), F.lower(F.col("lang").cast("string")).alias("lang"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).where("lang is not null")
    # hashes only, and of each task only the least; texts are fetched for the chosen rows
    least = own.select("lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= SAMPLE).drop("n")
    rows = own.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).repartition("lang")  # once, however often an id repeats
    return {r.lang: bytes(r.model) for r in rows.select("lang", "text").mapInArrow(_train, schema(lang=STR, model=BIN)).collect()}  # one row a language


def _likelihood(models):
    langs = sorted(models.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.stack([np.frombuffer(models.value[x], "<f4") for x in langs], 1).astype(float) if langs else np.zeros((BUCKETS, 0))
        for b in batches:
            out, says = [], []
            for at in range(0, b.num_rows, 64):
                pages = [t or b"" for t in b.column("html").slice(at, 64).to_pylist()]
                says += map(declared, pages)
                grams, n = _grams(list(map(visible, pages)))
                total = np.concatenate((np.zeros((1, len(langs))), np.cumsum(table[grams], 0)))
                ends = np.cumsum(n)
                sums = total[ends] - total[ends - n]
                out += (sums * (TEMPER * np.minimum(1.0, MOST_GRAMS / np.maximum(n, 1)))[:, None]).tolist()
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(says, pa.string()), pa.array(out, pa.list_(pa.float64()))], ["page_id", "url", "declared", "text"])

    return run


def _normal(logs: Column) -> Column:
    """Probabilities of log weights."""
    return F.transform(F.array(logs), lambda x: F.transform(F.array(F.array_max(x)), lambda m: F.transform(x, lambda v: F.exp(v - m)))[0])[0]


def _share(weights: Column) -> Column:
    return F.transform(F.array(weights), lambda w: F.transform(F.array(F.aggregate(w, F.lit(0.0), lambda a, v: a + v)), lambda s: F.transform(w, lambda v: v / s))[0])[0]


def _add(logs: Column, other: Column) -> Column:
    return F.zip_with(logs, other, lambda a, b: a + b)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host of each row of ``pages``."""
    models = fit(docs)
    langs = sorted(models)
    if not langs:
        return own_columns(pages, "page_id").select(F.col("page_id").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    own = own_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.col("html").cast("string"), "UTF-8").alias("html"))
    rows = own.mapInArrow(_likelihood(pages.sparkSession.sparkContext.broadcast(models)), "page_id long, url string, declared string, text array<double>")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    known = F.array(*[F.lit(x) for x in langs])
    k = len(langs)
    says = F.transform(known, lambda x: F.when(F.col("declared") == x, F.lit(DECLARED)).when(F.col("declared").isin(langs), F.lit((1 - DECLARED) / max(k - 1, 1))).otherwise(F.lit(1.0 / k)))
    seen = rows.withColumn("host", host).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    seen = seen.withColumn("own", _add(F.col("text"), F.transform(says, lambda v: F.log(v)))).withColumn("q", _share(_normal(F.col("own"))))
    seen = stored(seen.drop("url"), "evidence")
    # expected counts at each level; a level's rows are added up before the shuffle
    sums = lambda d, *by: d.groupBy(*by).agg(*[F.sum(F.col("q")[i]).alias(f"n{i}") for i in range(k)], F.count(F.lit(1)).alias("rows"))
    packed = lambda name: F.array(*[f"n{i}" for i in range(k)]).alias(name)
    hosts = sums(seen, "suffix", "domain", "host")
    up = lambda d, *by: d.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*[f"n{i}" for i in range(k)], "rows")])
    domains = up(hosts, "suffix", "domain")
    suffixes = up(domains, "suffix")
    everything = up(suffixes).first()  # one row
    every = F.array(*[F.lit(float(everything[i] or 0.0)) for i in range(k)])
    levels = hosts.select("suffix", "domain", "host", "rows", packed("at_host")).join(domains.select("suffix", "domain", packed("at_domain")), ["suffix", "domain"]).join(suffixes.select("suffix", packed("at_suffix")), "suffix")
    joined = join_hot(seen, levels, ["suffix", "domain", "host"], "rows", everything["rows"] or 0)

    def smoothed(counts: Column, above: Column) -> Column:
        """Shares of a level without the page's own part, drawn to those of the level above."""
        left = F.zip_with(counts, F.col("q"), lambda n, q: F.greatest(n - q, F.lit(0.0)))
        return _share(F.zip_with(left, above, lambda n, p: n + SMOOTH * p))

    logs = lambda c: F.transform(c, lambda v: F.log(v))
    joined = joined.withColumn("overall", smoothed(every, F.array_repeat(F.lit(1.0 / k), k)))
    joined = joined.withColumn("by_suffix", F.zip_with(smoothed(F.col("at_suffix"), F.col("overall")), "overall", lambda a, b: F.log(a) - F.log(b)))
    joined = joined.withColumn("prior", smoothed(F.col("at_host"), smoothed(F.col("at_domain"), F.col("overall"))))
    fused = joined.withColumn("p", _share(_normal(_add(_add(F.col("own"), F.col("by_suffix")), logs(F.col("prior"))))))
    best = lambda c: F.element_at(known, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), best(F.col("text")).alias("text_lang"), "declared", "host")
