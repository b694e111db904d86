"""Choice among candidate binnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn

#: Counters of a method: least completeness (exclusive unless noted), most contamination.
COUNTERS = {"n5010": (50, 10), "n7010": (70, 10), "n9010": (90, 10), "n505": (50, 5), "n705": (70, 5)}


def method_stats(quality: DataFrame) -> DataFrame:
    counts = {name: F.count_if((F.col("comp") > a) & (F.col("cont") < b)) for name, (a, b) in COUNTERS.items()} | {"n905": F.count_if((F.col("comp") >= 90) & (F.col("cont") <= 5))}
    return quality.groupBy("method").agg(*[c.alias(n) for n, c in counts.items()]).withColumn("total", sum((F.col(n) for n in counts), F.lit(0).cast("long")))


def best_methods(stats: DataFrame, group: str, least: int = 0) -> DataFrame:
    """Of each group the method with most near-complete bins and that with most bins in all; once if it is the same. A group of fewer than ``least`` methods is an error."""
    if least:
        n = F.count(F.lit(1)).over(Window.partitionBy(group))
        named = F.when(F.col("_n") >= least, F.col("method")).otherwise(F.raise_error(F.concat(F.lit("too few methods like "), "method")).cast("string"))
        stats = stats.withColumn("_n", n).withColumn("method", named)
    top = lambda c: stats.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), "method"))).where("r = 1").select(group, "method")
    return top("n905").union(top("total")).distinct()


def dereplicate(members: DataFrame) -> DataFrame:
    """The best member of each cluster by quality score."""
    scored = members.withColumn("score", F.round(fn.quality_score(F.col("comp"), F.col("cont")), 6))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "member"))).where("r = 1").select("rep", "member", "score")


def without_gaps(quality: DataFrame) -> DataFrame:
    """Drops bins whose two completeness estimates are far apart while that by marker genes is low."""
    return quality.where(~((F.abs(F.col("comp") - F.col("scg_comp")) > 40) & (F.col("scg_comp") < 10)))


def capped_parts(rows: DataFrame, limit: int) -> DataFrame:
    """Clusters at ``limit`` bp or more are cut into sum div limit + 2 near-equal parts."""
    w = Window.partitionBy("cluster")
    n, total = F.count(F.lit(1)).over(w), F.sum("len").over(w)
    out = rows.withColumn("n", n).withColumn("total", total)
    out = out.withColumn("parts", F.when(F.col("total") >= limit, F.expr(f"total div {limit} + 2")).otherwise(F.lit(1).cast("long")))
    step = F.expr("n div parts + 1")
    rn = F.row_number().over(w.orderBy("contig")) - 1
    return out.withColumn("rn", rn).select("cluster", "contig", F.expr("cast(rn as bigint)").alias("rn"), step.alias("step")).select("cluster", "contig", F.expr("rn div step").alias("part"))


def chunks(rows: DataFrame, by: str, order: str, parts: int) -> DataFrame:
    """The rows of each group in ``parts`` runs of n div parts + 1 rows; the last ones may be shorter or missing."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("_rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return numbered.withColumn("chunk", F.expr(f"_rn div (_n div {parts} + 1)")).drop("_rn", "_n")


def run_group(method: Column) -> Column:
    """The parameters of a clustering run but its bandwidth: the first eight parts of its name."""
    return F.array_join(F.slice(F.split(method, "_"), 1, 8), "_")


def with_qualities(pairs: DataFrame, external: DataFrame, own: DataFrame) -> DataFrame:
    """``pairs(rep, member)`` with two estimates of each member, ``external(member, comp, ...)`` and ``own(member, scg_comp, ...)``; members without both are left out."""
    return pairs.join(external, "member").join(own, "member")


def with_unassigned(parts: DataFrame, bare: DataFrame) -> DataFrame:
    """cluster, part, contig: the contigs of each part, and in each part all contigs of its cluster that no part has."""
    return parts.select("cluster", "part", "contig").unionByName(parts.select("cluster", "part").distinct().join(bare, "cluster").select("cluster", "part", "contig"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the rows of its last file."""
    last = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(last, [key, order], "left_semi")
