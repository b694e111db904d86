"""Scoring of bins against known genomes: overlap, confusion, F1, threshold grids, taxonomic roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import breadth


def overlap(aligned: DataFrame) -> DataFrame:
    """genome, bin, tp, genome_bp, bin_bp from ``aligned(genome, bin, subject, st, en)``.

    A bin's size is the sum of what it covers of each genome; few (genome, bin) pairs are left after the first aggregation.
    """
    tp = breadth(aligned, ["genome", "bin"]).withColumnRenamed("covered", "tp")
    genomes = breadth(aligned, ["genome"]).withColumnRenamed("covered", "genome_bp")
    return tp.join(genomes, "genome").withColumn("bin_bp", F.sum("tp").over(Window.partitionBy("bin")))


def scores(counts: DataFrame) -> DataFrame:
    recall, precision = F.col("tp") / F.col("genome_bp"), F.col("tp") / F.col("bin_bp")
    return counts.withColumns({"recall": recall, "precision": precision, "f1": 2 * F.col("tp") / (F.col("genome_bp") + F.col("bin_bp"))})


def confusion(counts: DataFrame, as_observed: bool = False) -> DataFrame:
    """tp, fp, fn, tn. True negatives are the reference less the other three; ``as_observed`` adds true positives back."""
    total = counts.select("genome", "genome_bp").distinct().agg(F.sum("genome_bp").alias("total"))
    out = counts.join(F.broadcast(total)).withColumns({"fp": F.col("bin_bp") - F.col("tp"), "fn": F.col("genome_bp") - F.col("tp")})  # one row
    tn = F.col("total") - F.col("fn") - F.col("fp") + F.col("tp") * (1 if as_observed else -1)
    return out.withColumn("tn", tn).drop("total")


def mcc() -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(below == 0, 0.0).otherwise((tp * tn - fp * fn) / below)


def best_by(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where("_rank = 1").drop("_rank")


def threshold_grid(scored: DataFrame, recalls: list[float], precisions: list[float], key: str = "genome") -> DataFrame:
    """How many genomes (or taxa) some bin recovers at each pair of thresholds."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(r, p) for r in recalls for p in precisions], "min_recall double, min_precision double")
    # the grid's size is that of its parameters
    hit = scored.select(key, "recall", "precision").join(F.broadcast(grid), (F.col("recall") >= F.col("min_recall")) & (F.col("precision") >= F.col("min_precision")))
    return grid.join(hit.groupBy("min_recall", "min_precision").agg(F.countDistinct(key).alias("n")), ["min_recall", "min_precision"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bin_lengths(aligned: DataFrame) -> DataFrame:
    """bin, bin_bp: the summed lengths of a bin's contigs; ``aligned(bin, contig, contig_len)``."""
    return aligned.select("bin", "contig", "contig_len").distinct().groupBy("bin").agg(F.sum("contig_len").alias("bin_bp"))


def genome_lengths(rows: DataFrame) -> DataFrame:
    """genome, genome_bp: the summed lengths of the subjects that any row names, admitted or not; ``rows(genome, subject, subject_len)``."""
    return rows.select("genome", "subject", "subject_len").distinct().groupBy("genome").agg(F.sum("subject_len").alias("genome_bp"))


def rank_grid(scored: DataFrame, ranks: DataFrame, names: list[str], recalls: list[float], precisions: list[float]) -> DataFrame:
    """min_recall, min_precision, rank, n: how many genomes, and taxa of each rank, some bin recovers; ``ranks(genome, *names)``. All ranks are counted in one pass."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(r, p) for r in recalls for p in precisions], "min_recall double, min_precision double")
    # the grid's size is that of its parameters
    hit = scored.select("genome", "recall", "precision").join(F.broadcast(grid), (F.col("recall") >= F.col("min_recall")) & (F.col("precision") >= F.col("min_precision")))
    hit = hit.select("genome", "min_recall", "min_precision").distinct().join(ranks, "genome")
    counts = hit.groupBy("min_recall", "min_precision").agg(*[F.countDistinct(c).alias(c) for c in ("genome", *names)])
    full = grid.join(counts, ["min_recall", "min_precision"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("rank"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for c in ("genome", *names)])).alias("x")
    return full.select("min_recall", "min_precision", each).select("min_recall", "min_precision", "x.*")
