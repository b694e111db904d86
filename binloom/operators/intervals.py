"""Interval operators over half-open [st, en): union breadth, depth, winsorised depth statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def breadth(rows: DataFrame, by: list[str], subject: str = "subject") -> DataFrame:
    """Covered positions of each group: a sweep over intervals sorted by start that carries the furthest end.

    Of intervals that start alike only the longest goes through the shuffle, so a subject brings no more rows than it has positions,
    however many reads it holds. A window's partition is one group's subject.
    """
    distinct = rows.where("en > st").groupBy(*by, subject, "st").agg(F.max("en").alias("en"))
    reach = F.max("en").over(Window.partitionBy(*by, subject).orderBy("st").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("en") - F.greatest("st", F.coalesce("reach", "st")))
    return distinct.withColumn("reach", reach).groupBy(*by).agg(F.sum(gain).alias("covered"))


def depth_runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Runs of equal depth: by, st, en, depth. Events at equal places are added before the shuffle; positions are never expanded."""
    events = rows.select(*by, F.explode(F.array(F.struct(F.col("st").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("en").alias("pos"), F.lit(-1).alias("step")))).alias("e")).select(*by, "e.*")
    events = events.groupBy(*by, "pos").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*by).orderBy("pos")
    runs = events.withColumn("depth", F.sum("step").over(w)).withColumn("en", F.lead("pos").over(w))
    return runs.where("en is not null and depth > 0").select(*by, F.col("pos").alias("st"), "en", "depth")


def depth_histogram(runs: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """by, depth, n: positions at each depth, those without cover as depth 0; ``lengths`` has each group's length."""
    covered = runs.groupBy(*by, "depth").agg(F.sum(F.col("en") - F.col("st")).alias("n"))
    bare = lengths.join(covered.groupBy(*by).agg(F.sum("n").alias("c")), by, "left").select(*by, F.lit(0).cast("long").alias("depth"), (F.col("length") - F.coalesce("c", F.lit(0))).alias("n")).where("n > 0")
    return covered.unionByName(bare)


def winsorised(hist: DataFrame, by: list[str], share: float = 0.975) -> DataFrame:
    """by, cap, mean, std: depths cut at the whole part of their percentile, then mean and standard deviation, from the histogram."""
    cap = hist.groupBy(*by).agg(F.floor(F.expr(f"percentile(depth, {share}, n)")).alias("cap"))
    d = F.least("depth", "cap")
    joined = hist.join(cap, by)
    sums = joined.groupBy(*by).agg(F.first("cap").alias("cap"), F.sum("n").alias("n"), F.sum(d * F.col("n")).alias("s"), F.sum(d * d * F.col("n")).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select(*by, "cap", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)).alias("std"))
