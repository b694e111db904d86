"""Refinement of clusters by marker genes: evaluation, splits in up to three levels, and the grid of graph clusterings before it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..steps import dropped, numbered, written
from . import clustering, markers, mixture, partition

#: From this many contigs on candidates are ranked by inertia instead of silhouettes.
LARGE = 90_000


def qualities(members: DataFrame, counts: DataFrame, bacteria: DataFrame, archaea: DataFrame) -> DataFrame:
    """cluster, domain, comp, cont of ``members(cluster, contig)``, from ``counts(contig, gene, n)`` and the marker sets (set_id, gene) of both domains."""
    of = members.join(counts, "contig", "left").groupBy(F.col("cluster").alias("bin"), "gene").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    of = written(of)
    return markers.domain_choice(markers.genome_check(of, bacteria), markers.genome_check(of, archaea)).withColumnRenamed("bin", "cluster")


def _best_split(x: np.ndarray, w: np.ndarray, tries: list[int], which: str) -> np.ndarray:
    """Labels of the best number of parts: by silhouette, for very many rows by inertia."""
    found = []
    for k in tries:
        if which == "von":
            _, label, inertia = mixture.fit_rows(x, k)
        else:
            c, label, _ = partition.swapped_kmeans(x, w, k)
            inertia = float(((x - c[label]) ** 2).sum())
        found.append((partition.silhouette(x, label) if len(x) < LARGE else -inertia, label))
    return max(found, key=lambda f: f[0])[1]


def split(members: DataFrame, vecs: DataFrame, groups: DataFrame, wanted: str = "flspp", shortest: int = 768) -> DataFrame:
    """cluster, contig, part of clusters cut by their vectors, the longest part first.

    ``members(cluster, contig, len)``, ``vecs(contig, vec)`` and ``groups(cluster, groups)``, how many groups a first-fit allocation needs.
    A cluster is one group of a grouped map, as all candidates need its vectors; up to three contigs stay whole, and so do clusters without genes.
    """
    rows = members.join(vecs, "contig").join(groups, "cluster")
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    rows = rows.withColumn("n", size).withColumn("which", clustering.algorithm(F.col("n"), wanted)).withColumn("tries", clustering.split_counts(F.col("groups").cast("long"), F.col("n")))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["len", "contig"], ascending=[False, True])
        part = np.zeros(len(pdf), int)
        if len(pdf) > 3:
            x = np.stack(pdf.vec.to_numpy()).astype(float)
            tries = sorted({min(max(2, int(t)), len(pdf) - 1) for t in pdf.tries.iloc[0]}) or [2]
            label = _best_split(x, np.log(pdf.len.to_numpy(float)) / np.log(float(shortest)), tries, pdf.which.iloc[0])
            bp = pd.Series(pdf.len.to_numpy()).groupby(label).sum().sort_values(ascending=False, kind="stable")
            part = pd.Series(np.arange(len(bp)), index=bp.index).loc[label].to_numpy()
        return pd.DataFrame({"cluster": pdf.cluster, "contig": pdf.contig, "part": part})

    return rows.groupBy("cluster").applyInPandas(cut, "cluster string, contig long, part int")


def _allocated(members: DataFrame, counts: DataFrame, domains: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """cluster, contig, group, n_genes: first-fit allocation by the genes of each cluster's own domain."""
    genes = sets["bacteria"].select("gene").distinct().withColumn("domain", F.lit("bacteria")).unionByName(sets["archaea"].select("gene").distinct().withColumn("domain", F.lit("archaea")))
    own = members.join(domains.select("cluster", "domain"), "cluster").join(counts, "contig").join(genes, ["domain", "gene"])
    of = own.groupBy("cluster", "contig", "len").agg(F.map_from_entries(F.collect_list(F.struct("gene", F.col("n").cast("long")))).alias("genes"))
    return markers.first_fit(of).join(of.select("cluster", "contig", F.size("genes").alias("n_genes")), ["cluster", "contig"])


def unlearned(members: DataFrame, allocated: DataFrame, shortest: int = 25_000) -> DataFrame:
    """cluster, contig, part: the groups that ``clustering.unlearned_split`` keeps, by rank, each with all contigs that carry no gene. A cluster of up to three contigs, or without genes, stays whole."""
    small = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n <= 3").select("cluster")
    large, of = members.join(small, "cluster", "left_anti"), allocated.join(small, "cluster", "left_anti")
    kept = clustering.unlearned_split(of, large, shortest).select("cluster", F.col("part").alias("group"), (F.col("rank") - 1).alias("part"))
    carrying = of.join(kept, ["cluster", "group"]).select("cluster", "contig", "part")
    bare = large.join(of.select("cluster", "contig"), ["cluster", "contig"], "left_anti").join(kept.select("cluster", "part"), "cluster").select("cluster", "contig", "part")
    whole = members.join(of.select("cluster").distinct(), "cluster", "left_anti").select("cluster", "contig", F.lit(0).alias("part"))
    return carrying.unionByName(bare).unionByName(whole)


def refine(members: DataFrame, vecs: DataFrame, counts: DataFrame, bacteria: DataFrame, archaea: DataFrame, wanted: str = "flspp", shortest: int = 768) -> tuple[DataFrame, DataFrame]:
    """Candidate bins (cluster, contig, len) and their qualities (cluster, domain, comp, cont, level).

    ``members(cluster string, contig long, len)``. Every cluster is a candidate. One with more than 10 % contamination is split by its
    vectors, one with more than 5 % is allocated by its genes; of the parts of a split the same holds once more, and those that
    are good enough, like all parts of the second time, are candidates. Names of parts hang on their cluster's.
    """
    sets = {"bacteria": bacteria, "archaea": archaea}
    out, quality = [], []
    now = written(members.select(F.col("cluster").cast("string").alias("cluster"), "contig", "len"))
    for level in range(3):
        of = written(qualities(now, counts, bacteria, archaea).withColumn("level", F.lit(level)))
        todo = of.withColumn("action", clustering.action(F.round("cont", 9)))
        # what isn't cut again is a candidate, of the first level everything
        stay = of.select("cluster") if level in (0, 2) else todo.where("action = 'keep'").select("cluster")
        out.append(now.join(stay, "cluster", "left_semi"))
        quality.append(of.join(stay, "cluster", "left_semi"))
        if level == 2:
            break
        cut = todo.where("action != 'keep'")
        rows = now.join(cut.select("cluster"), "cluster", "left_semi")
        found = written(_allocated(rows, counts, of, sets))
        groups = found.groupBy("cluster").agg((F.max("group") + 1).alias("groups"))
        learn = rows.join(cut.where("action = 'split'").select("cluster"), "cluster", "left_semi")
        plain = rows.join(cut.where("action = 'allocate'").select("cluster"), "cluster", "left_semi")
        parts = split(learn, vecs, groups, wanted, shortest).unionByName(unlearned(plain, found.join(plain.select("cluster").distinct(), "cluster", "left_semi")))
        named = written(parts.join(rows, ["cluster", "contig"]).select(F.concat("cluster", F.lit("."), F.col("part").cast("string")).alias("cluster"), "contig", "len", F.col("cluster").alias("of")))
        again = named.join(cut.where("action = 'split'").select(F.col("cluster").alias("of")), "of", "left_semi") if level == 0 else named
        if level == 0:  # parts of an allocation aren't cut again
            done = written(named.join(cut.where("action = 'allocate'").select(F.col("cluster").alias("of")), "of", "left_semi").drop("of"))
            out.append(done)
            quality.append(qualities(done, counts, bacteria, archaea).withColumn("level", F.lit(1)))
        now = written(again.drop("of"))
    both = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(both(frames[1:]))
    return both(out), both(quality)


# --- the grid of graph clusterings


RESOLUTIONS, BANDWIDTHS, RATIOS, NEIGHBOURS = (8, 2, 12, 4, 6, 1, 10), (0.05, 0.2, 0.1, 0.15), (100, 50, 75), (100, 75)


def grid_rounds(nodes: int) -> int:
    """The surveyed engine's bound of a run's rounds, for callers that want it as ``rounds`` of ``grid``; -1 is until one brings nothing."""
    return 24 if nodes >= 1_000_000 else 28 if nodes >= 950_000 else 30 if nodes >= 900_000 else -1


#: Edges or nodes in a row of the packed graph.
PACKED = 4096


def _packed(names: list[str], kinds: list[str]):
    """Chunks of rows as packed bytes, a column each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PACKED):
                cols = [zlib.compress(np.asarray(batch.column(n).slice(i, PACKED).cast(pa.float64() if k == "f8" else pa.int64())).astype(k).tobytes(), 1) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], ["a", "b", "c", "d"])

    return run


def _percentiles(rows: DataFrame, name: str, ratios) -> list[float]:
    """Exact percentiles as ``F.percentile`` has them, which holds all distinct values in one task; here rows are sorted and the few at the places are read. -1 without rows."""
    placed = written(numbered(rows.where(F.col(name).isNotNull()), name))
    places = [(placed.count() - 1) * (r / 100) for r in ratios]
    wanted = sorted({int(f(p)) for p in places for f in (np.floor, np.ceil)})
    at = {r["at"]: r[name] for r in placed.where(F.col("at").isin(wanted)).collect()}  # two rows a ratio
    dropped(placed)

    def value(p: float) -> float:
        low, high = int(np.floor(p)), int(np.ceil(p))
        return at[low] if low == high or at[low] == at[high] else (high - p) * at[low] + (p - low) * at[high]

    return [value(p) if p >= 0 else -1.0 for p in places]


def grid(near: DataFrame, nodes: DataFrame, resolutions=RESOLUTIONS, bandwidths=BANDWIDTHS, ratios=RATIOS, neighbours=NEIGHBOURS, rounds: int = -1) -> DataFrame:
    """run, contig, community of every set of parameters; ``near(src, dst, d2, rank)`` and ``nodes(id, size, fixed)``.

    A run's graph is one task's, as many runs side by side as there are tasks; one graph too large for a task goes through
    ``clustering.communities`` instead, run by run. Edges are cut at the percentile of all distances of a number of neighbours. The neighbours are
    written once, packed; each run's task reads them there (a Cartesian product, not a shuffle) and takes its edges, so disk doesn't grow with the runs.
    A run goes on until a round brings nothing, whatever the number of nodes, unless ``rounds`` bounds it.
    """
    spark = near.sparkSession
    near = written(near.where(F.col("rank") <= max(neighbours)).select("src", "dst", "d2", "rank"))
    cut = {(r, k): x for k in neighbours for r, x in zip(ratios, _percentiles(near.where(F.col("rank") <= k).select("d2"), "d2", ratios))}
    runs = [(float(r), float(b), q, k) for r in resolutions for b in bandwidths for q in ratios for k in neighbours]
    schema = "a binary, b binary, c binary, d binary"
    edges = near.where("src > dst").select("src", "dst", "d2", "rank").mapInArrow(_packed(["src", "dst", "d2", "rank"], ["i8", "i8", "f8", "i4"]), schema)
    whole = nodes.select("id", F.col("size").cast("double").alias("size"), F.col("fixed").cast("long").alias("fixed"), F.lit(0).alias("none"))
    packed = written(edges.withColumn("edge", F.lit(True)).unionByName(whole.mapInArrow(_packed(["id", "size", "fixed", "none"], ["i8", "f8", "i1", "i1"]), schema).withColumn("edge", F.lit(False))))
    dropped(near)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, own, found = None, [], ([], [], [])
        for batch in batches:
            at = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                run = at["run"][i].as_py()
                read = lambda c, t: np.frombuffer(zlib.decompress(at[c][i].as_buffer()), t)  # noqa: B023, E731
                if not at["edge"][i].as_py():
                    own.append([read(c, t) for c, t in zip("abc", ("i8", "f8", "i1"))])
                    continue
                _, _, q, k = runs[run]
                kept = (read("d", "i4") <= k) & (read("c", "f8") <= cut[q, k])
                for c, t, of in zip("abc", ("i8", "i8", "f8"), found):
                    of.append(read(c, t)[kept])
        if not own:
            return
        batch = at = None
        pa.default_memory_pool().release_unused()
        resolution, bandwidth, q, k = runs[run]
        ids, size, fixed = (np.concatenate(x) for x in zip(*own))
        order = np.argsort(ids)
        ids, size, fixed = ids[order], size[order], fixed[order] > 0

        def ends(of: list[np.ndarray]) -> np.ndarray:
            """Places of ids, in a smaller type; what they are made of isn't held any longer."""
            out = np.concatenate([np.searchsorted(ids, x).astype(np.int32 if len(ids) < 1 << 31 else np.int64) for x in of] or [np.zeros(0, np.int32)])
            of.clear()
            return out

        src, dst, d2 = ends(found[0]), ends(found[1]), np.concatenate(found[2] or [np.zeros(0)])
        found[2].clear()
        order = np.lexsort((dst, src))
        src, dst, weight = src[order], dst[order], np.exp(-d2[order] / bandwidth)
        del order, d2
        label = partition.communities(len(ids), src, dst, weight, size, resolution, fixed, rounds=rounds)
        name = f"Leiden_embMat0_maxedges_{k}_partgraphRatio_{q}_resolution_{resolution}_bandwidth_{bandwidth}"
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), pa.array(label.astype("int64"))], ["run", "contig", "community"])

    each = spark.range(0, len(runs), 1, len(runs)).withColumnRenamed("id", "run").hint("shuffle_replicate_nl")  # a partition a run
    return packed.coalesce(1).crossJoin(each).mapInArrow(one, "run string, contig long, community long")
