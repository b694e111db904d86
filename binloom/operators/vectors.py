"""Vector operators over unit embeddings: exact neighbours, edges, clustering steps, contrastive losses.

All-pairs operators are block products: rows are dealt to blocks, each pair of blocks is one task's matrix product in
numpy, so a task holds two blocks whatever the table's size and rows are never joined pairwise in the plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def _blocked(v: DataFrame, symmetric: bool) -> DataFrame:
    """Rows of ``v(id, vec, ...)`` copied to each pair of blocks that holds them, with the side."""
    blocks = max(1, -(-v.count() // BLOCK_ROWS))
    dealt = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.withColumn("x", F.col("block")).withColumn("y", other).withColumn("side", F.lit(0))
    right = dealt.withColumn("y", F.col("block")).withColumn("x", other).withColumn("side", F.lit(1))
    both = left.unionByName(right)
    return both.where("x <= y") if symmetric else both


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k least values, ascending, of equal ones the first columns."""
    if k < d.shape[1]:
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = np.divmod(np.arange(d.size), d.shape[1])
    order = np.lexsort((d[row, col], row))  # stable, so by column
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept]


def _nearest(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``b`` to each row of ``a``, and one more for a tie."""
    b = b.sort_values("id")
    x, y = np.stack(a.vec.to_numpy()).astype(float), np.stack(b.vec.to_numpy()).astype(float)
    rows = []
    for i in range(0, len(x), 256):
        d = np.square(x[i : i + 256, None, :] - y[None, :, :]).sum(2) if x.shape[1] * len(y) < 1 << 17 else np.maximum(0, (x[i : i + 256] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x[i : i + 256] @ y.T)
        d[a.id.to_numpy()[i : i + 256, None] == b.id.to_numpy()[None, :]] = np.inf
        at, near = _least(np.round(d, 9), k + 1)
        rows.append(pd.DataFrame({"src": a.id.to_numpy()[i + at], "dst": b.id.to_numpy()[near], "d2": d[at, near]}))
    out = pd.concat(rows)
    return out[np.isfinite(out.d2)]


def _near_block(k: int, both: bool):
    """The nearest rows of side 1 to each row of side 0 of a pair of blocks; with ``both`` also the other way round, if they are two."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": [], "d2": []}).astype({"src": "int64", "dst": "int64"})
        found = _nearest(a, b, k)
        return pd.concat([found, _nearest(b, a, k)]) if both and int(pdf.x.iloc[0]) != int(pdf.y.iloc[0]) else found

    return block


def knn(v: DataFrame, k: int) -> DataFrame:
    """src, dst, d2, rank: the exact k nearest others by squared distance; ties by id. Each pair of blocks is met once, for both of its sides."""
    found = _blocked(v, True).groupBy("x", "y").applyInPandas(_near_block(k, True), "src long, dst long, d2 double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("d2", 9), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Rows that an index's centres are fitted on, at most; every row is indexed.
INDEX_SAMPLE = 20_000


#: Share of the neighbours within the sample that the default number of lists must hold.
RECALL = 0.95


def _enough(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of the nearest lists hold RECALL of the neighbours of some rows of the sample."""
    d2 = lambda x, y: (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
    asked = sample[:500]
    d = d2(asked, sample)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(d2(asked, centres), axis=1), axis=1)
    ranks = np.take_along_axis(place, d2(sample, centres).argmin(1)[near], 1).ravel()
    return int(np.quantile(ranks, RECALL, method="higher")) + 1 if ranks.size else 1


def knn_index(v: DataFrame, k: int, lists: int | None = None, probes: int | None = None, seed: int = 3407) -> DataFrame:
    """src, dst, d2, rank: the k nearest others among the rows of the ``probes`` nearest lists.

    Centres of the lists are fitted on ``INDEX_SAMPLE`` rows of least hash; every row goes to the list of its nearest centre and looks into its
    nearest ones. Lists are cut into blocks of ``BLOCK_ROWS``, so a crowded one is many tasks'. By default there are as many
    lists as the root of the number of rows, and as many are looked into as hold ``RECALL`` of the neighbours within the sample.
    """
    from . import partition

    n = v.count()
    lists = lists or max(1, int(n**0.5))
    sample = np.array([r.vec for r in v.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(INDEX_SAMPLE).collect()], float)
    if not len(sample):
        return knn(v, k)
    rng = np.random.default_rng(seed)
    centres, _, _ = partition.lloyd(sample, np.ones(len(sample)), partition.spread(sample, np.ones(len(sample)), min(lists, len(sample)), rng), 10)
    lists = len(centres)
    probes = min(lists, probes or _enough(sample, centres, k))
    at = v.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(vecs: pd.Series) -> pd.Series:
        x = np.stack(vecs.to_numpy()).astype(float)
        d = (at.value**2).sum(1)[None] - 2 * x @ at.value.T
        return pd.Series(np.argsort(d, axis=1, kind="stable")[:, :probes].tolist())

    placed = v.withColumn("near", nearest("vec"))
    sizes = placed.groupBy(F.col("near")[0].alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))  # one row a list
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = placed.withColumn("list", F.col("near")[0]).join(F.broadcast(sizes), "list").select("list", part.alias("y"), "id", "vec", F.lit(1).alias("side"), "blocks")
    asks = placed.withColumn("list", F.explode("near")).join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "id", "vec", F.lit(0).alias("side"), "blocks")
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-n // (BLOCK_ROWS * lists)) * probes))).cast("int")
    chunks = F.sequence(F.lit(0), F.lit(max(1, -(-n // (BLOCK_ROWS * lists)) * probes) - 1))
    both = asks.withColumn("x", chunk).unionByName(held.withColumn("x", F.explode(chunks))).drop("blocks")
    found = both.groupBy("list", "x", "y").applyInPandas(_near_block(k, False), "src long, dst long, d2 double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("d2", 9), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pair_sums(v: DataFrame, t: float = 2.0) -> DataFrame:
    """n, potential (sum of exp(-t d2)) over unordered pairs, and for each label-equal pair n_same and d2_same; ``v(id, vec, label)``."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = np.zeros(4)
        x, y = (np.stack(p.vec.to_numpy()).astype(float) for p in (a, b)) if len(a) and len(b) else (None, None)
        for i in range(0, len(a) if x is not None else 0, 512):
            d = np.maximum(0, (x[i : i + 512] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x[i : i + 512] @ y.T)
            once = a.id.to_numpy()[i : i + 512, None] < b.id.to_numpy()[None, :] if int(pdf.x.iloc[0]) == int(pdf.y.iloc[0]) else np.ones_like(d, bool)
            same = once & (a.label.to_numpy()[i : i + 512, None] == b.label.to_numpy()[None, :])
            out += [once.sum(), np.exp(-t * d)[once].sum(), same.sum(), d[same].sum()]
        return pd.DataFrame([out], columns=["n", "potential", "n_same", "d2_same"])

    parts = _blocked(v, True).groupBy("x", "y").applyInPandas(block, "n double, potential double, n_same double, d2_same double")
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def build_edges(near: DataFrame, ratio: float, bandwidth: float) -> DataFrame:
    """Edges under the percentile of all squared distances, each kept once (from the larger id), with their weight."""
    cut = near.agg(F.expr(f"percentile(d2, {ratio})").alias("cut"))
    kept = near.join(F.broadcast(cut), F.col("d2") <= F.col("cut")).where("src > dst")  # one row
    return kept.select("src", "dst", "d2", F.exp(-F.col("d2") / bandwidth).alias("weight"))


def centroids(v: DataFrame, by: str) -> DataFrame:
    """by, n, mean: element-wise means, added up in each task first."""
    parts = v.select(by, F.posexplode("vec").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def class_distances(v: DataFrame) -> DataFrame:
    """id, label, other, total, n: the sum of distances from each row to the others of each label, and their number."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "label": [], "other": [], "total": [], "n": []}).astype({"id": "int64", "label": "int64", "other": "int64", "n": "int64"})
        x, y = np.stack(a.vec.to_numpy()).astype(float), np.stack(b.vec.to_numpy()).astype(float)
        names, code = np.unique(b.label.to_numpy(), return_inverse=True)
        member = np.eye(len(names))[code]
        rows = []
        for i in range(0, len(x), 512):
            part = a.iloc[i : i + 512]
            d = np.sqrt(np.maximum(0, (x[i : i + 512] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x[i : i + 512] @ y.T))
            other = part.id.to_numpy()[:, None] != b.id.to_numpy()[None, :]
            rows.append(pd.DataFrame({"id": np.repeat(part.id.to_numpy(), len(names)), "label": np.repeat(part.label.to_numpy(), len(names)), "other": np.tile(names, len(part)), "total": ((d * other) @ member).ravel(), "n": (other @ member).ravel().astype("int64")}))
        return pd.concat(rows)

    parts = _blocked(v, False).groupBy("x", "y").applyInPandas(block, "id long, label long, other long, total double, n long")
    return parts.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")


def silhouette(v: DataFrame) -> DataFrame:
    """id, label, s: (b - a) / max(a, b) of the mean distances to the own label and to the nearest other; 0 for a label's only row."""
    mean = F.col("total") / F.col("n")
    of = class_distances(v).groupBy("id", "label").agg(F.max(F.when(F.col("other") == F.col("label"), mean)).alias("a"), F.min(F.when(F.col("other") != F.col("label"), mean)).alias("b"))
    return of.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def rber_quality(edges: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """community, inner, size, q: inner edge weight less ``resolution`` times what the mean density lets expect.

    ``edges(src, dst, weight)``, each once; ``nodes(id, community, size)``.
    """
    whole = nodes.agg(F.sum("size").alias("all")).join(edges.agg(F.sum("weight").alias("w")))  # one row
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    inner = edges.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.sum("weight").alias("inner"))
    sizes = nodes.groupBy("community").agg(F.sum("size").alias("size"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    of = sizes.join(inner, "community", "left").join(F.broadcast(whole)).withColumn("inner", F.coalesce("inner", F.lit(0.0)))  # one row
    return of.select("community", "inner", "size", (F.col("inner") - resolution * F.col("w") / pairs("all") * pairs("size")).alias("q"))


def label_ranks(v: DataFrame, by: str) -> DataFrame:
    """r: the place of each row's own label among all labels by the product with their means; ties by label. The means are a matrix of one row a label."""
    c = centroids(v, by).orderBy(by).collect()  # one row a label
    names, means = np.array([r[by] for r in c]), np.array([r["mean"] for r in c], float)
    at = v.sparkSession.sparkContext.broadcast((names, means))

    @F.pandas_udf("int")
    def rank(vecs: pd.Series, label: pd.Series) -> pd.Series:
        names, means = at.value
        s = np.round(np.stack(vecs.to_numpy()).astype(float) @ means.T, 9)
        own = np.searchsorted(names, label.to_numpy())
        mine = s[np.arange(len(s)), own][:, None]
        return pd.Series(1 + (s > mine).sum(1) + ((s == mine) & (np.arange(len(names))[None] < own[:, None])).sum(1))

    return v.select(rank("vec", by).alias("r"))


def with_centres(v: DataFrame, by: str) -> DataFrame:
    """``v`` with ``centres``: label, n, mean of every group as one array; there are as many as groups."""
    c = centroids(v, by).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("label"), "n", "mean"))).alias("centres"))
    return v.join(F.broadcast(c))  # one row
