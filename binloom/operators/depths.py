"""Features of contigs from the depths of several samples: mean, deviation, their maxima, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals


def contig_depths(reads: DataFrame, contigs: DataFrame, files: DataFrame) -> DataFrame:
    """file, contig, mean, std of winsorised depths; a contig without reads of a file has zeros.

    ``reads(file, contig, st, en)``, ``contigs(contig, len)``, ``files(file)``, the list of samples, which is small.
    """
    known = reads.join(contigs, "contig").select("file", "contig", "st", F.least("en", "len").alias("en")).where("en > st")  # reads of other contigs don't count
    runs = intervals.depth_runs(known, ["file", "contig"])
    lengths = known.select("file", "contig").distinct().join(contigs, "contig").select("file", "contig", F.col("len").alias("length"))
    found = intervals.winsorised(intervals.depth_histogram(runs, lengths, ["file", "contig"]), ["file", "contig"])
    each = contigs.select("contig", F.explode(F.array(*[F.lit(r.file) for r in files.orderBy("file").collect()])).alias("file"))  # a row a sample
    zero = F.lit(0.0)
    return each.join(found, ["file", "contig"], "left").select("file", "contig", F.coalesce("mean", zero).alias("mean"), F.coalesce("std", zero).alias("std"))


def maxima(depths: DataFrame, most: float = 1000.0) -> DataFrame:
    """file, mean, std: the largest of each file's contigs, a little above zero; all halved where one is beyond ``most``."""
    top = depths.groupBy("file").agg((F.max("mean") + 1e-5).alias("mean"), (F.max("std") + 1e-5).alias("std"))
    all_ = top.agg(F.max("mean").alias("m"), F.max("std").alias("s"))
    half = lambda c, x: F.when(F.col(x) > most, F.col(c) / 2).otherwise(F.col(c)).alias(c)
    return top.join(F.broadcast(all_)).select("file", half("mean", "m"), half("std", "s"))  # one row


def composition_maxima(composition: DataFrame) -> DataFrame:
    """file, top: half the largest coverage of a k-mer of each file; ``composition(file, contig, kmer, cov)``."""
    return composition.groupBy("file").agg((F.max("cov") / 2).alias("top"))


def scaled(depths: DataFrame, tops: DataFrame, limits: DataFrame) -> DataFrame:
    """file, contig, mean, std: means over ``tops(file, top)``, deviations over the file's largest in ``limits(file, std)``. One row a file in both."""
    by = tops.join(limits.select("file", F.col("std").alias("most")), "file")
    return depths.join(F.broadcast(by), "file").select("file", "contig", (F.col("mean") / F.col("top")).alias("mean"), (F.col("std") / F.col("most")).alias("std"))


def scaled_composition(composition: DataFrame, tops: DataFrame) -> DataFrame:
    return composition.join(F.broadcast(tops), "file").select("file", "contig", "kmer", (F.col("cov") / F.col("top")).alias("cov"))  # one row a file
