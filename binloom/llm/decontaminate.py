"""Benchmark decontamination: one Aho-Corasick automaton over all test items; each text is scanned once.

Both sides are normalised alike (A-Z lower-cased, words of digits, letters and everything beyond ASCII). A window is
thirteen consecutive words of an item, or the whole of a shorter item. The automaton's letters are words. Its patterns
are the items' blocks of seven words, cut one behind another: every window holds a whole one, so a window of the item
occurs where a block does and the words beside it agree far enough. That takes a node a word of the items, instead of thirteen for
patterns that are windows. Hits are word positions, which ``spans`` maps to characters of the original.

The items go to every Python worker (about 0.18 KB there a word of the items). Their size is measured first; beyond
``MOST_BYTES`` of text the call fails with a message before any work is done, as the workers' memory must be sized for it.

Odd cases: a null or wordless text has no words, no hits, isn't contaminated and gives the digest of the empty string.
Null or wordless items have no windows. An item without an id counts for hits, not for items; items that repeat an id
count as one. Repeated documents give a row each; a null ``doc_id`` stays null. No documents, no rows; no items, no hits.
Other columns of ``documents`` are kept by ``clean`` and put aside by ``report``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own_columns

WINDOW = 13
#: Words to a block; every window of the item holds a whole one, as 2 * BLOCK - 1 is WINDOW.
BLOCK = 7
#: Text of all items that workers are sent at most.
MOST_BYTES = 64 << 20
#: Byte by byte: A-Z to a-z, words as they are, all else to a space.
_NORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[bytes, tuple] = {}


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORM).split()


def automaton(items: list[tuple[str | None, bytes | None]]) -> tuple:
    """Automaton over word numbers, and the numbering. A block's value: for each surrounding the words before it (nearest first), those after it, and whose it is."""
    number: dict[bytes, int] = {}
    found: dict[tuple, dict[tuple, set]] = {}
    reach = WINDOW - BLOCK
    for item, text in items:
        w = tuple(number.setdefault(x, len(number) + 1) for x in words(text))
        size = BLOCK if len(w) >= WINDOW else len(w)  # a shorter item is a pattern itself
        for at in range(0, len(w) - size + 1, max(1, size)) if w else ():
            around = (w[max(0, at - reach) : at][::-1], w[at + size : at + size + reach], len(w) < WINDOW)
            found.setdefault(w[at : at + size], {}).setdefault(around, set()).update(() if item is None else (item,))
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for block, arounds in found.items():
        auto.add_word(block, (len(block), tuple((*around, tuple(who)) for around, who in arounds.items())))
    if found:
        auto.make_automaton()
    return auto if found else None, number


def _agree(w: tuple, at: int, step: int, other: tuple) -> int:
    """How many of ``other`` stand in ``w`` from ``at`` on, in steps."""
    n = 0
    for x in other:
        if not 0 <= at < len(w) or w[at] != x:
            break
        n, at = n + 1, at + step
    return n


def scan(text: bytes | None, auto, number: dict) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, runs [from, to) of hit words, items."""
    w = tuple(map(number.get, words(text), repeat(0)))
    hits: list[tuple[int, int]] = []
    items: set = set()
    if auto is not None and w:
        for end, (n, arounds) in auto.iter(w):
            at = end + 1 - n
            for before, after, whole, who in arounds:
                lo = at if whole else at - _agree(w, at - 1, -1, before)
                hi = end + 1 if whole else end + 1 + _agree(w, end + 1, 1, after)
                if whole or hi - lo >= WINDOW:
                    hits.append((lo, hi))
                    items.update(who)
    runs: list[list[int]] = []
    for a, b in sorted(hits):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return len(w), [(a, b) for a, b in runs], items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as [from, to) characters of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


_STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _pass(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256(repr(items.value).encode()).digest()
        if digest not in _built:
            _built.clear()
            _built[digest] = automaton(items.value)
        auto, number = _built[digest]
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        for b in batches:
            out = []
            for text in b.column("text"):
                n, runs, who = scan(text.as_py(), auto, number)
                out.append({"n_words": n, "runs": [x for r in runs for x in r], "items": sorted(who)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "state"])

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(row, text, state): each row of ``docs`` with its words, hit runs (flat list of from, to) and items."""
    bench = own_columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), F.encode("text", "UTF-8").alias("text")).where("text is not null").distinct()
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the items hold {size} bytes of text, workers are sent {most} at most: size their memory and raise the bound")
    items = docs.sparkSession.sparkContext.broadcast(sorted(((r.item_id, bytes(r.text)) for r in bench.collect()), key=repr))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return rows.mapInArrow(_pass(items), T.StructType([*rows.schema.fields, T.StructField("state", _STATE)]))


def _verdict(rows: DataFrame) -> DataFrame:
    pairs = F.aggregate(F.transform("state.runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_hit", pairs).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("state.n_words")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``."""
    rows = _verdict(annotate(own_columns(docs, "doc_id", "text"), benchmark))
    ids = F.array_join(F.array_sort("state.items"), ",")
    return rows.select("row.doc_id", "state.n_words", "n_hit", F.size("state.items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the hit passages of each document that has some, as [from, to) characters of its text."""

    def run(batches):
        for b in batches:
            out = [[{"start": a, "end": z} for a, z in spans(t.decode(), list(zip(r[::2], r[1::2])))] for t, r in zip(b.column("text").to_pylist(), b.column("runs").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    rows = annotate(own_columns(docs, "doc_id", "text"), benchmark).where(F.size("state.runs") > 0)
    return rows.select("row.doc_id", "text", "state.runs").mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long>>")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    return _verdict(annotate(docs, benchmark)).where(~F.col("contaminated")).select("row.*")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS (SELECT rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM d),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d JOIN w USING (rid) LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
