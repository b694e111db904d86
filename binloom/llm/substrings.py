"""Exact substring de-duplication: bytes covered by a string of ``LENGTH`` bytes that also starts earlier are removed.

Bucket-pointer refinement to depth ``LENGTH``, spread over a cluster. The bucket of a position at depth 8 is the code of the
8-gram there. At depth d + k it is named after two buckets of depth d: the position's own and that of the later offset
k. So buckets of depth 8 give those of 16, these give 32 (``GRAM``), 64, 85, 97 and 100; each level's names are the next
one's input. A name is a keyed 64-bit mix of the pair, not a rank, so a task that holds a text knows the buckets at all its
offsets without asking others; the key is drawn for each run. Members of a bucket meet in one task, sorted by the
identifier of the later offsets, and buckets with a single member drop out.

1. Every window of ``LENGTH`` bytes holds the same least 32-gram wherever it occurs, so only these positions (about one
   in 35) are bucketed; each stands for a run of windows. Buckets with one run are done: none of its windows occurs elsewhere.
2. A bucket is sorted by the identifier of the whole run, made of the buckets at later (and the run's earlier) offsets.
   Of equal runs all but the first are duplicates.
3. What is left, first runs whose bucket holds unequal ones, is refined recursively: a run is cut into cells of 16, 4
   and at last 1 window; a cell's bucket is that of the bytes which all its windows share (depth 85, 97, 100). Each level
   drops what is alone, removes what is equal, and hands on the rest. The bytes of what is left after step 2 are cut out once; no
   later level sees a whole text.

Nothing is equal by fewer than three 64-bit names (the bucket's, and the run's under two keys). Each batch of rows first
removes its own duplicates, so a bucket, however large its group of copies, brings a shuffle at most a row a batch; a
q-gram with unequal runs in one batch is marked so, by one row, and its runs are shuffled by their own identifier instead.

Odd cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing. Each row is a document of its own, in the
order of ``doc_id`` (null first), then of the text's hash: rows that share an id, or have none, keep their own bytes. Of
rows equal in both the first one counts; the others lose all, as any later copy does. No rows in, no rows out. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, LONG, STR, own_columns, schema, stored

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Windows to a cell, level by level.
CELLS = (16, 4, 1)
_CHUNK = 1 << 19
_MARK = -(1 << 63)
Keys = tuple[tuple[int, ...], tuple[int, ...]]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _pair(a: np.ndarray, b: np.ndarray, key: tuple[int, ...]) -> np.ndarray:
    """Names of pairs of buckets, under a key."""
    h = a ^ np.uint64(key[0])
    h *= np.uint64(key[1])
    h ^= h >> np.uint64(32)
    h += b * np.uint64(key[2])
    return _mix(h)


def _keys() -> Keys:
    return tuple(tuple(secrets.randbits(64) | 1 for _ in range(3)) for _ in range(2))


class _Buffer:
    """Some texts end to end, and the buckets of their positions."""

    def __init__(self, texts: list[bytes], keys: Keys):
        self.a = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        self.keys, self.size = keys, len(self.a) - 8
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.codes = np.empty(self.size + 1, np.uint64)  # of the 8-grams: the buckets of depth 8
        for o in range(min(8, len(self.codes))):
            self.codes[o::8] = np.frombuffer(self.a, "<u8", offset=o, count=len(range(o, len(self.codes), 8)))

    def grams(self, lane: int, at: np.ndarray | None = None) -> np.ndarray:
        """Buckets of depth 32 of all positions, or of some."""
        key, c = self.keys[lane], self.codes
        if at is None:
            if (n := self.size - GRAM + 1) <= 0:
                return np.zeros(0, np.uint64)
            half = _pair(c[: n + 16], c[8 : n + 24], key)
            return _pair(half[:n], half[16 : n + 16], key)
        return _pair(_pair(c[at], c[at + 8], key), _pair(c[at + 16], c[at + 24], key), key)

    def buckets(self, lane: int, depth: int) -> np.ndarray:
        """Buckets of a depth beyond 32 of all positions, each level from the one before it and a later offset."""
        now, at = self.grams(lane), GRAM
        for to in (64, *(LENGTH + 1 - c for c in CELLS)):
            if at < depth:
                now, at = _pair(now[: max(0, len(now) - to + at)], now[to - at :], self.keys[lane]), to
        return now

    def run(self, lane: int, p: np.ndarray, first: np.ndarray, last: np.ndarray, grams: np.ndarray | None = None) -> np.ndarray:
        """Identifier of a run: the buckets at its offsets, 32 bytes apart, and where its windows stand to its q-gram."""
        of = (lambda at: grams[at]) if grams is not None else (lambda at: self.grams(lane, at))
        found = ((p - first) * 128 + last - first).astype(np.uint64)
        for j in range(0, SPAN - 1 + LENGTH, GRAM):
            found = _pair(found, of(np.minimum(first + j, last + LENGTH - GRAM)), self.keys[lane])
        return found

    def runs(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, place of the least q-gram, first and last window of each run; places are in the buffer."""
        if self.size < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        low = np.uint64((1 << 20) - 1)
        m = (v & ~low) | np.arange(len(v), dtype=np.uint64)  # the leftmost of equal ones
        for w in (1, 2, 4, 8, 16, 32):
            m = np.minimum(m[:-w], m[w:])
        m = np.minimum(m[: -(SPAN - 64)], m[SPAN - 64 :])
        owner = (m & low).astype(np.int64)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)[: len(owner)]
        whole = np.arange(len(owner)) + LENGTH <= (self.starts + self.sizes)[text]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        ends = np.append(np.flatnonzero(new | ~whole), len(owner))
        last = ends[np.searchsorted(ends, first, "right")] - 1
        return text[first], owner[first], first, last


def _buffers(texts: list[bytes], keys: Keys) -> Iterator[tuple[_Buffer, np.ndarray, np.ndarray]]:
    """Buffers of bounded size with the number of each text and where in its document it starts; a long text comes in overlapping parts."""
    part, own, at, size = [], [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - LENGTH + 1), _CHUNK):
            piece = t[lo : lo + _CHUNK + LENGTH - 1]
            if part and size + len(piece) > _CHUNK + LENGTH:
                yield _Buffer(part, keys), np.array(own, np.int64), np.array(at, np.int64)
                part, own, at, size = [], [], [], 0
            part.append(piece)
            own.append(i)
            at.append(lo)
            size += len(piece)
    if part:
        yield _Buffer(part, keys), np.array(own, np.int64), np.array(at, np.int64)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns.values()], list(columns))


def _rows(key: np.ndarray, run: np.ndarray, check: np.ndarray, doc: np.ndarray, dig: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows to be bucketed: key, run, check, document (doc, dig), packed place, kind (0 to be seen, 1 known to be one of several, 2 known duplicate, 3 mark of several)."""
    order = np.lexsort((place, dig, doc, run, key))
    key, run, check, doc, dig, place = (x[order] for x in (key, run, check, doc, dig, place))
    equal = np.concatenate(([False], (key[1:] == key[:-1]) & (run[1:] == run[:-1]) & (check[1:] == check[:-1])))
    again = equal & np.concatenate(([False], (doc[1:] == doc[:-1]) & (dig[1:] == dig[:-1]) & (place[1:] == place[:-1])))  # a repeated row
    key, run, check, doc, dig, place, dup = (x[~again] for x in (key, run, check, doc, dig, place, equal))
    firsts = np.flatnonzero(~dup)
    c = key[firsts]
    mixed = np.zeros(len(c), bool)
    mixed[1:] |= c[1:] == c[:-1]
    mixed[:-1] |= c[:-1] == c[1:]
    marks = np.unique(c[mixed])
    several = np.zeros(len(key), bool)
    several[firsts[mixed]] = True
    key = key.copy()
    key[several] ^= _mix(run[several])
    key[dup] = _mix(doc[dup].astype(np.uint64) ^ _mix(place[dup].astype(np.uint64) ^ dig[dup].astype(np.uint64)))
    yield _batch({"key": key, "run": run, "check": check, "doc": doc, "dig": dig, "place": place, "kind": np.where(dup, 2, np.where(several, 1, 0))})
    if len(marks):
        zero = np.zeros(len(marks), np.int64)
        yield _batch({"key": marks, "run": np.full(len(marks), _MARK), "check": zero, "doc": zero, "dig": zero, "place": zero, "kind": np.full(len(marks), 3)})


def _runs(keys: Keys):
    """Runs of each text, to be bucketed by their least q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, dig, found = np.asarray(b.column("doc")), np.asarray(b.column("dig")), []
            for buf, own, at in _buffers([t or b"" for t in b.column("text").to_pylist()], keys):
                v = buf.grams(0)
                text, p, first, last = buf.runs(v)
                if len(p):
                    place = ((p - buf.starts[text] + at[text]) << 14) | ((p - first) << 7) | (p - last)
                    found.append((v[p], buf.run(0, p, first, last, v), buf.run(1, p, first, last), doc[own[text]], dig[own[text]], place))
            if found:
                yield from _rows(*(np.concatenate(x) for x in zip(*found)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a text that the runs in ``places`` cover, none overlapping: where each starts, and its bytes."""
    for b in batches:
        starts, parts = [], []
        for t, places in zip(b.column("text"), b.column("places")):
            t, q = t.as_buffer(), np.sort(places.values.to_numpy())
            lo, hi = (q >> 14) - ((q >> 7) & 127), (q >> 14) - (q & 127) + LENGTH
            order = np.argsort(lo, kind="stable")
            lo, top = lo[order], np.maximum.accumulate(hi[order])
            new = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1])))
            begin, end = lo[new].tolist(), top[np.append(new[1:], len(lo)) - 1].tolist()
            starts.append(begin)
            parts.append([t[x:y].to_pybytes() for x, y in zip(begin, end)])
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("dig"), b.column("places"), pa.array(starts, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.binary()))], ["doc", "dig", "places", "starts", "parts"])


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Groups of (document, part of a stretch, where the part starts, runs or cells in it), of bounded bytes together."""
    group, size = [], 0
    for i in range(batch.num_rows):
        q = np.unique(batch.column("places")[i].values.to_numpy())
        first = (q >> 14) - ((q >> 7) & 127)
        order = np.argsort(first, kind="stable")
        q, first = q[order], first[order]
        begin = batch.column("starts")[i].values.to_numpy()
        of = np.searchsorted(begin, first, "right") - 1  # the stretch that holds it
        parts = batch.column("parts")[i].values
        for k in np.unique(of).tolist():
            mine = q[of == k] if len(begin) > 1 else q
            t, start = parts[k].as_buffer(), int(begin[k])
            for lo in range(0, t.size, _CHUNK):  # a long stretch comes in overlapping parts
                at = (mine >> 14) - ((mine >> 7) & 127) - start
                here = mine[(at >= lo) & (at < lo + _CHUNK)] if t.size > _CHUNK else mine
                if not len(here):
                    continue
                part = t[lo : min(t.size, lo + _CHUNK + SPAN + LENGTH)].to_pybytes()
                if group and size + len(part) > _CHUNK:
                    yield group
                    group, size = [], 0
                group.append((i, part, start + lo, here))
                size += len(part)
    if group:
        yield group


def _cells(cell: int, keys: Keys):
    """Cells of the runs in ``places``, to be bucketed by the bytes that all their windows share."""
    depth = LENGTH + 1 - cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, digs, found = np.asarray(b.column("doc")), np.asarray(b.column("dig")), []
            for group in _groups(b):
                rows, parts, starts, places = zip(*group)
                buf = _Buffer(list(parts), keys)
                ids = [buf.buckets(lane, depth) for lane in (0, 1)]
                n = [len(x) for x in places]
                shift = np.repeat(buf.starts - np.array(starts), n)
                q, row = np.concatenate(places), np.repeat(np.array(rows), n)
                p, a, z = q >> 14, (q >> 7) & 127, q & 127  # windows start z .. a before p
                cells = a // cell - z // cell + 1
                at = np.repeat(np.arange(len(q)), cells)
                c = z[at] // cell + np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
                p, row, shift = p[at], row[at], shift[at]
                a, z = np.minimum(a[at], c * cell + cell - 1), np.maximum(z[at], c * cell)
                x = p + shift
                stand = (a * 128 + z).astype(np.uint64)
                run_, check = (_pair(_pair(v[x - a], v[x - z + LENGTH - depth], k), stand, k) for v, k in zip(ids, keys))
                found.append((ids[0][x - z] if cell == 1 else ids[0][x - c * cell] ^ _mix(c.astype(np.uint64)), run_, check, docs[row], digs[row], (p << 14) | (a << 7) | z))
            if found:
                yield from _rows(*(np.concatenate(x) for x in zip(*found)))

    return run


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "doc", "dig", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for b in batches:
        rows = []
        for t, spans in zip(b.column("text").to_pylist(), b.column("spans")):
            t = t or b""
            found = np.unique(spans.values.to_numpy()) if spans.is_valid and len(spans.values) else np.zeros(0, np.int64)
            lo, hi = found >> 8, np.minimum((found >> 8) + (found & 255) + LENGTH - 1, len(t))  # starts lo .. lo + n - 1
            top = np.maximum.accumulate(hi) if len(hi) else hi
            new = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1]))) if len(lo) else np.zeros(0, np.int64)
            starts, ends = lo[new], top[np.append(new[1:], len(lo)) - 1] if len(lo) else new
            cuts = [0, *np.stack((starts, ends), 1).ravel().tolist(), len(t)]
            kept = b"".join(t[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
            rows.append((len(t), len(t) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:3]], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)


def dedup(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``; with ``text`` also the bytes kept."""
    keys = _keys()
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    own = own.withColumn("doc", F.coalesce("doc_id", F.lit(_MARK).cast("long"))).withColumn("dig", F.xxhash64("text"))
    row = ["doc", "dig"]
    kind = schema(key=LONG, run=LONG, check=LONG, doc=LONG, dig=LONG, place=LONG, kind=LONG)
    bucket, whole = Window.partitionBy("key").orderBy("run", "doc", "dig", "place"), Window.partitionBy("key")
    as_before = lambda *cols: F.coalesce(sum((F.when(F.lag(c).over(bucket) == F.col(c), 0).otherwise(1) for c in cols), F.lit(0)) == 0, F.lit(False))
    several = (F.min("run").over(whole) != F.max("run").over(whole)) | (F.col("kind") == 1)

    def sorted_out(rows: DataFrame, what: str) -> DataFrame:
        """doc, dig, place and whether it is a duplicate, of what isn't alone."""
        # a known duplicate's key is its own, so it is alone in its bucket; a mark sorts before the runs of its bucket
        seen = rows.select(*row, "place", "kind", as_before("run", "check").alias("before"), as_before(*row, "place").alias("twin"), several.alias("several")).where("kind != 3 and not (twin and before)")
        return stored(seen.select(*row, "place", (F.col("before") | (F.col("kind") == 2)).alias("dup"), "several").where("dup or several").drop("several"), what)

    left = lambda state: state.where("not dup").groupBy(*row).agg(F.collect_list("place").alias("places"))  # noqa: E731 - a document's own places
    state = sorted_out(own.select(*row, "text").mapInArrow(_runs(keys), kind), "runs")
    removed, lists = state.where("dup"), T.ArrayType
    cut = T.StructType([*schema(doc=LONG, dig=LONG).fields, T.StructField("places", lists(LONG)), T.StructField("starts", lists(LONG)), T.StructField("parts", lists(BIN))])
    stretches = stored(own.select(*row, "text").join(left(state), row).mapInArrow(_cut, cut), "stretches")
    for level, cell in enumerate(CELLS):
        rows = stretches if level == 0 else stretches.drop("places").join(left(state), row)
        state = sorted_out(rows.mapInArrow(_cells(cell, keys), kind), f"cells{cell}")
        removed = removed.unionByName(state.where("dup"))
    lo, n = F.shiftright("place", 14) - F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.shiftright("place", 7).bitwiseAND(F.lit(127)) - F.col("place").bitwiseAND(F.lit(127)) + 1
    spans = removed.groupBy(*row).agg(F.collect_list(F.shiftleft(lo, 8) + n).alias("spans"))
    done = own.join(spans, row, "left").select("doc_id", *row, "text", "spans").mapInArrow(_final, schema(doc_id=LONG, doc=LONG, dig=LONG, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept_sha256=STR, kept=BIN))
    # of rows equal in id and text one stands for the first, the others are later copies
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])]
    each = done.groupBy("doc_id", *row).agg(F.first(F.struct(*out)).alias("x"), F.count(F.lit(1)).alias("times")).select("doc_id", "x", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    lost = (F.col("time") > 1) & (F.col("x.n_bytes") >= LENGTH)
    late = {"n_removed": F.col("x.n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept": F.lit(b"")}
    return each.select("doc_id", *[F.when(lost, late[c]).otherwise(F.col(f"x.{c}")).alias(c) if c in late else F.col(f"x.{c}").alias(c) for c in out])


#: Texts as hexadecimal digits, two a byte; every window of every text, its first place, and the bytes that later ones cover.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, s, substr(h, 2 * s + 1, {2 * LENGTH}) AS x FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS s FROM d WHERE len(h) >= {2 * LENGTH})),
late AS (SELECT rid, s FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY rid, s) > 1),
edge AS (SELECT rid, s, s > coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), -{LENGTH + 1}) + {LENGTH} AS new FROM late),
run AS (SELECT rid, s, sum(new::INT) OVER (PARTITION BY rid ORDER BY s) AS k FROM edge),
span AS (SELECT rid, min(s) AS lo, max(s) + {LENGTH} AS hi FROM run GROUP BY rid, k),
gap AS (SELECT rid, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS lo, lo AS hi FROM span UNION ALL SELECT rid, max(hi), NULL FROM span GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, len(h) // 2) - lo)), '' ORDER BY lo) AS k FROM gap JOIN d USING (rid) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM span GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
