"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, drop_scratch, join_hot, schema, stored

#: Edges that a task contracts at once.
LOCAL = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the least node of each of their components."""
    parts = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches]
    if not sum(len(a) for a, _ in parts):
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["a", "b"])


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
    return join_hot(both, least, ["a"], "rows", 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
    tied = join_hot(down, least, ["a"], "rows", n).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of ``edges(a long, b long)`` but the least of its component, with that least node.

    First each task contracts up to ``LOCAL`` edges. Then alternating large and small stars: as many rounds as the logarithm of the longest path, each written to the shared
    folder. A hub's rows are aggregated before the shuffle and take the least neighbour by broadcast (``join_hot``).
    """
    all_ = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, now, old = None, all_.repartition(max(1, -(-all_.count() // LOCAL))).mapInArrow(_contract, schema(a=LONG, b=LONG)), all_
    while True:
        now = stored(_small_star(_large_star(now, seen[0]), seen[0]) if seen is not None else now, "stars")
        drop_scratch(old)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            return now
        seen, old = mark, now
