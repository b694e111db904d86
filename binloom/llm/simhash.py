"""SimHash fingerprints and exact near-duplicate components.

Distinct fingerprints are compared tile by tile: a tile is a run of rows, two tiles are compared by numpy exclusive-or
and bit counts, and a pair of tiles whose population counts differ beyond the radius is skipped. Which rows can share a
tile follows from the pigeon-hole rule: of ``b`` blocks of a fingerprint at least ``b - RADIUS`` are equal in any linked
pair, so each choice of that many blocks gives a key, and only rows with an equal key need meet. No pair within the
radius is lost. Groups of equal keys beyond ``HOT_ROWS`` are split by population count and hash into tiles that are
paired over many tasks. A tile pair gives the stars of its own components, never all of its pairs.

Odd cases: a null or blank text has no words and fingerprint zero, linked like any other. Equal ids and repeated rows
give a row each. A null ``doc_id`` gives a row, but never names a component unless the component has null ids only
(then it is null). No rows in, no rows out. Other columns are ignored by ``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG, LOWER, UPPER, join_hot, own_columns, schema, stored
from .graph import components

SEED, SHINGLE, RADIUS = 42, 3, 3
TILE, HOT_ROWS, HOT_TILE = 512, 8192, 4096
#: Blocks of a fingerprint, by how many distinct fingerprints they serve with some 256 rows to a key.
BLOCKS = ((4, 2**24), (5, 2**33), (6, 2**63))
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of a whole text over hashed shingles of three words."""
    words = (text or b"").translate(_LOW).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    s, e, h = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, len(s), _CHUNK):
        hashes = np.array([h(joined[i:j], SEED) for i, j in zip(s[at : at + _CHUNK], e[at : at + _CHUNK])], np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(s), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found)], [*names, "fp"])


def fingerprints(docs: DataFrame, hashes: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long; on demand ``h`` between them, the hash of the text."""
    hashed = [F.xxhash64("text").alias("h")] if hashes else []
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), *hashed, F.encode(F.col("text"), "UTF-8").alias("text"))
    return own.mapInArrow(_prints, schema(doc_id=LONG, h=LONG, fp=LONG) if hashes else schema(doc_id=LONG, fp=LONG))


def block_keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """One key for each choice of ``blocks - radius`` blocks; the choice is in the key."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def _stars(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Edges that join the components of the pairs (x[i], y[j]) within the radius: each member with one other."""
    hit = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return None
    hit, lx, ly = hit[np.ix_(rows, cols)], None, np.arange(len(cols))
    while True:  # the least column that a component reaches is its label
        lx = np.where(hit, ly[None, :], len(cols)).min(1)
        new = np.minimum(ly, np.where(hit, lx[:, None], len(cols)).min(0))
        new = new[new]
        if (new == ly).all():
            break
        ly = new
    a, b = np.concatenate((x[rows], y[cols])), np.concatenate((y[cols][lx], y[cols][ly]))
    return a[a != b], b[a != b]


def _edges(found: list) -> pa.RecordBatch:
    a, b = (np.concatenate([f[i] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, bits, ones): each tile against itself and against the earlier tiles that its first key reaches into."""
    held: list[tuple] = []  # earlier tiles: last key, fingerprints, least and most ones
    rest: tuple | None = None

    def tile(key: np.ndarray, fp: np.ndarray, ones: np.ndarray) -> list:
        held[:] = [t for t in held if (t[0] == key[0]).all()]
        low, most = int(ones.min()), int(ones.max())
        found = [_stars(fp, fp, RADIUS)] + [_stars(f, fp, RADIUS) for _, f, lo, hi in held if lo - RADIUS <= most and low - RADIUS <= hi]
        held.append((key[-1], fp, low, most))
        return [f for f in found if f is not None]

    for b in batches:
        fp = np.asarray(b.column("fp")).view(np.uint64)
        new = (np.stack((np.asarray(b.column("choice")).astype(np.int64), np.asarray(b.column("bits"))), 1), fp, np.bitwise_count(fp))
        now = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
        whole = len(now[1]) // TILE * TILE
        found = [f for at in range(0, whole, TILE) for f in tile(*(x[at : at + TILE] for x in now))]
        rest = tuple(x[whole:] for x in now)
        yield _edges(found)
    if rest is not None and len(rest[1]):
        yield _edges(tile(*rest))


def _pair(t: pa.Table) -> pa.Table:
    """One pair of hot tiles; a tile paired with itself has rows on the first side only."""
    fp, side = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy()
    x, y = fp[side == 0], fp[side == 1]
    y = y if len(y) else x
    found = [_stars(x[i : i + 1024], y[j : j + 1024], RADIUS) for i in range(0, len(x), 1024) for j in range(0, len(y), 1024)]
    return pa.Table.from_batches([_edges([f for f in found if f is not None])])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges among the distinct fingerprints ``prints(fp)`` whose components are those of all links."""
    n = prints.count()
    blocks = next(b for b, most in BLOCKS if n <= most)
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), blocks)).alias("k")).select("fp", "k.*", F.bit_count("fp").alias("ones"))
    sizes = keyed.groupBy("choice", "bits", "ones").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.join(sizes.groupBy("choice", "bits").agg(F.sum("n").alias("all")).where(F.col("all") > HOT_ROWS).drop("all"), ["choice", "bits"]).select("choice", "bits", "ones", F.ceil(F.col("n") / HOT_TILE).alias("tiles")), "hot")
    on = ["choice", "bits"]
    cold = keyed.join(hot.select(*on).distinct(), on, "left_anti")
    cold = cold.repartition(*on).sortWithinPartitions(*on, "ones").select("choice", "bits", "fp")
    out = cold.mapInArrow(_tiled, schema(a=LONG, b=LONG))
    # hot keys: tiles of (ones, part), pairs of tiles whose ones are near enough, and the rows of both sides
    tiles = hot.select(*on, "ones", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)).alias("part"))
    first, other = tiles.withColumnRenamed("ones", "ones1").withColumnRenamed("part", "part1"), tiles.withColumnRenamed("ones", "ones2").withColumnRenamed("part", "part2")
    near = (F.col("ones2").between(F.col("ones1"), F.col("ones1") + RADIUS)) & ((F.col("ones2") > F.col("ones1")) | (F.col("part2") >= F.col("part1")))
    pairs = first.join(other, on).where(near)
    pair = ["choice", "bits", "ones1", "part1", "ones2", "part2"]
    rows = keyed.join(hot, on + ["ones"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).drop("tiles")
    left = rows.withColumnsRenamed({"ones": "ones1", "part": "part1"}).join(pairs, on + ["ones1", "part1"]).select(*pair, "fp", F.lit(0).alias("side"))
    right = rows.withColumnsRenamed({"ones": "ones2", "part": "part2"}).join(pairs.where("ones1 != ones2 or part1 != part2"), on + ["ones2", "part2"]).select(*pair, "fp", F.lit(1).alias("side"))
    return out.unionByName(left.unionByName(right).groupBy(*pair).applyInArrow(_pair, schema(a=LONG, b=LONG)))


def _rooted(distinct: DataFrame) -> DataFrame:
    """``distinct``, a row for each fingerprint, with the ``root`` of its component."""
    roots = components(links(distinct.select("fp")))
    return distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    seen = stored(fingerprints(docs), "prints")
    distinct = stored(seen.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    linked = stored(_rooted(distinct), "rooted")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    total, prints = distinct.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    of = join_hot(linked.select("fp", "rows", "root"), named, ["root"], "members", prints)
    return join_hot(seen, stored(of.select("fp", "component_id", "rows"), "named"), ["fp"], "rows", total)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component: that of the smallest id (null ids last), then fingerprint, then hash of text.

    Rows to stay are chosen on keys alone. Of rows with the same id and text, which count as one, any stays.
    """
    none, id0 = F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id0")
    seen = stored(fingerprints(docs, hashes=True), "prints")
    once = seen.groupBy("fp", none, id0, "h").agg(F.count(F.lit(1)).alias("rows"))
    distinct = stored(once.groupBy("fp").agg(F.min(F.struct("none", "id0", "h", "rows")).alias("first"), F.sum("rows").alias("all")), "distinct")
    stay = _rooted(distinct).groupBy("root").agg(F.min(F.struct("first.none", "first.id0", "fp", "first.h", "first.rows")).alias("x"))
    stay = stored(stay.select("x.none", "x.id0", "x.h", "x.rows", F.col("x.rows").alias("same")), "stay")
    total = distinct.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.col("row.doc_id").cast("long")
    rows = rows.withColumns({"none": key.isNull(), "id0": F.coalesce(key, F.lit(0)), "h": F.xxhash64("row.text")})
    kept = join_hot(rows, stay, ["none", "id0", "h"], "rows", total, "shuffle_hash")  # a row a component: never a broadcast, and texts aren't sorted
    several = kept.where("same > 1").dropDuplicates(["none", "id0", "h"])
    return kept.where("same = 1").unionByName(several).select("row.*") if stay.where("same > 1").head(1) else kept.select("row.*")
