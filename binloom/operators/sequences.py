"""Sequence operators: contigs, k-mers, composition, segments, N50 and the rules that follow from lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical, clean_sequence, gumbel, uniform
from ..functions import view as fn_view
from ..steps import numbered

#: Bases that are looked at together.
_STRETCH = 1 << 20


def contigs(docs: DataFrame) -> DataFrame:
    """contig, source, seq, len"""
    return docs.select(F.col("doc_id").alias("contig"), "source", clean_sequence(F.col("text")).alias("seq")).withColumn("len", F.length("seq").cast("long"))


def n50(lengths: DataFrame, *by: str) -> DataFrame:
    """N50 for each group: the largest length at which the running sum, longest first, reaches half.

    Lengths are counted first, so the window runs over distinct lengths, not over contigs.
    """
    counts = lengths.where("len > 0").groupBy(*by, "len").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    running = F.sum(F.col("len") * F.col("n")).over(group.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.col("len") * F.col("n")).over(group)
    reached = counts.withColumn("running", running).withColumn("total", total).where("2 * running >= total")
    return reached.groupBy(*by).agg(F.max("len").alias("n50"))


_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = 0, 1, 2, 3


def _counted(k: int, by: list[str]):
    """Counts of k-mers of each batch and group, by the words' numbers; words with other letters are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = pa.table({n: b.column(n) for n in by}).to_pylist() if by else [()] * b.num_rows
            names: dict[tuple, int] = {}
            of = [names.setdefault(tuple(g.values()) if by else (), len(names)) for g in groups]
            total = np.zeros((len(names), 4**k), np.int64)
            for g, seq in zip(of, b.column("seq")):
                raw = seq.as_buffer() if seq.is_valid else None
                if raw is None or raw.size < k:
                    continue
                for at in range(0, raw.size, _STRETCH):
                    x = _CODE[np.frombuffer(raw[at : min(raw.size, at + _STRETCH + k - 1)], np.uint8)]
                    n = len(x) - k + 1
                    if n <= 0:
                        continue
                    word, bad = np.zeros(n, np.int64), np.zeros(n, bool)
                    for j in range(k):
                        word = word * 4 + x[j : j + n]
                        bad |= x[j : j + n] == 4
                    total[g] += np.bincount(word[~bad], minlength=4**k)
            g, w = np.nonzero(total)
            keys = list(names)
            cols = [pa.array([keys[i][c] for i in g.tolist()], b.schema.field(n).type) for c, n in enumerate(by)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(w), pa.array(total[g, w])], [*by, "word", "n"])

    return run


def kmer_counts(seqs: DataFrame, k: int, *by: str, canon: bool = True) -> DataFrame:
    """Histogram of k-mers of ``seq``; those with letters other than A, C, G, T are ignored. Texts are counted batch by batch, so at most 4**k rows a group and batch are shuffled; words are spelt, and joined with their reverse, after that."""
    kind = T.StructType([*[seqs.schema[c] for c in by], T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])
    counts = seqs.select(*by, F.encode("seq", "UTF-8").alias("seq")).mapInArrow(_counted(k, list(by)), kind).groupBy(*by, "word").agg(F.sum("n").alias("n"))
    kmer = F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright("word", 2 * (k - 1 - j)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for j in range(k)])
    named = counts.select(*by, kmer.alias("kmer"), "n")
    if not canon:
        return named
    return named.groupBy(*by, canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))


def composition(seqs: DataFrame, k: int, *by: str) -> DataFrame:
    """Share of each canonical k-mer within its group."""
    return kmer_counts(seqs, k, *by).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def segments(seqs: DataFrame, parts: int, k: int) -> DataFrame:
    """``parts`` equal segments of each contig, the rest cut off; one shorter than k is widened to k bases where there are as many."""
    gap = F.greatest(F.lit(1), F.expr(f"cast(len div {parts} as int)"))
    cut = seqs.withColumn("gap", gap).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    start = F.col("segment") * F.col("gap") + 1
    narrow = F.col("gap") < k
    short = F.when(start + k - 1 <= F.col("len"), start).otherwise(F.greatest(F.lit(1), F.col("len").cast("int") - k + 1))
    return cut.select("contig", "segment", F.when(narrow, F.substring("seq", short, F.lit(k))).otherwise(F.substring("seq", start, F.col("gap"))).alias("seq"))


def vocabulary(spark, k: int) -> DataFrame:
    """All k-mers in the order A, T, G, C with the index of their pair."""
    letters = [F.substring(F.lit("ATGC"), (F.floor(F.col("id") / 4**j) % 4 + 1).cast("int"), F.lit(1)) for j in reversed(range(k))]
    words = spark.range(0, 4**k, 1, 1).select(F.concat(*letters).alias("kmer"))  # 4**k rows, by the definition of the vocabulary
    digits = lambda c: F.translate(c, "ATGC", "0123")
    first = F.least(digits(F.col("kmer")), digits(F.reverse(F.translate("kmer", "ACGT", "TGCA"))))
    return words.select("kmer", canonical(F.col("kmer")).alias("canon"), (F.dense_rank().over(Window.orderBy(first)) - 1).cast("int").alias("idx"))


def _ranked_lengths(seqs: DataFrame) -> DataFrame:
    """Distinct lengths with how many contigs are longer."""
    counts = seqs.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("longer", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def min_length(seqs: DataFrame, ratio: float, long: int = 1000, floor: int = 768) -> DataFrame:
    """The shortest length to use: one less than the short contig that follows ``ratio`` times as many short ones as there are long ones."""
    ranked = _ranked_lengths(seqs.select("len"))
    known = ranked.agg(F.coalesce(F.sum(F.when(F.col("len") >= long, F.col("n"))), F.lit(0)).alias("n_long"))
    after = ranked.where(F.col("len") < long).join(F.broadcast(known)).withColumn("at", F.floor(F.col("n_long") * ratio) + F.col("n_long"))  # one row
    return after.where("longer <= at and at < longer + n").agg(F.greatest(F.lit(floor).cast("long"), F.coalesce(F.max(F.expr("(len - 1) div 10 * 10")), F.lit(floor).cast("long"))).alias("min_length"))


def lower_bound(seqs: DataFrame, shortest: int, batch: int) -> DataFrame:
    """How far below ``shortest`` the training set reaches to fill whole batches."""
    ranked = _ranked_lengths(seqs.select("len"))
    known = ranked.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("len") >= shortest, F.col("n"))), F.lit(0)).alias("enough"))
    cover = F.when(F.col("enough") <= batch, F.lit(batch).cast("long")).otherwise(F.expr(f"(enough div {batch} + least(3L, (total - enough) div {batch})) * {batch}"))
    at = ranked.join(F.broadcast(known)).withColumn("at", F.least(cover, F.col("total") - 1))  # one row
    return at.where("longer <= at and at < longer + n").select((F.lit(shortest).cast("long") - F.col("len")).alias("gap"))


def top_batches(seqs: DataFrame, batch: int) -> DataFrame:
    """contig, len of the longest contigs, cut to whole batches; of those as long as the last, the least by name.

    The cut follows from the histogram of lengths, so only contigs of the one length at the cut are ranked.
    """
    ranked = _ranked_lengths(seqs.select("len"))
    keep = ranked.agg(F.expr(f"sum(n) div {batch} * {batch}").alias("keep"))
    cut = ranked.join(F.broadcast(keep)).where("longer < keep").withColumn("left", F.least(F.col("n"), F.col("keep") - F.col("longer")))  # one row
    rows = seqs.select("contig", "len").join(cut, "len")
    tied = rows.where("left < n").withColumn("_rank", F.row_number().over(Window.partitionBy("len").orderBy("contig"))).where("_rank <= left")
    return rows.where("left = n").select("contig", "len").unionByName(tied.select("contig", "len"))


def coverage_composition(seqs: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """contig, kmer, cov: depth summed over the places of each canonical k-mer, over k times the contig's length.

    ``runs(contig, st, en, depth)`` are runs of equal depth, none overlapping. A word's depth is the difference of two sums of the
    depths before its ends, so the work is in proportion to the bases and the runs.
    """
    own = runs.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("st", "en", "depth"))).alias("runs"))  # at most two a base
    both = seqs.where(F.col("len") >= k).select("contig", F.encode("seq", "UTF-8").alias("seq")).join(own, "contig")
    both = both.select("contig", "seq", F.col("runs.st").alias("st"), F.col("runs.en").alias("en"), F.col("runs.depth").alias("depth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _CODE[np.frombuffer(b.column("seq")[i].as_buffer(), np.uint8)]
                st, en, depth = (b.column(c)[i].values.to_numpy() for c in ("st", "en", "depth"))
                step = np.zeros(len(x) + 1, np.int64)
                np.add.at(step, np.minimum(st, len(x)), depth)
                np.add.at(step, np.minimum(en, len(x)), -depth)
                before = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]))))  # depths before each place
                n = len(x) - k + 1
                word, back, bad = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
                for j in range(k):
                    c = x[j : j + n].astype(np.int64)
                    word, back, bad = word * 4 + c, back + ((3 - c) << (2 * j)), bad | (c == 4)
                word = np.minimum(word, back)
                sums = np.bincount(word[~bad], (before[k:] - before[:n])[~bad], 4**k)
                w = np.flatnonzero(sums > 0)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("contig")[i].as_py()] * len(w), b.schema.field("contig").type), pa.array(w), pa.array(sums[w] / (k * len(x)))], ["contig", "word", "cov"])

    kind = T.StructType([both.schema["contig"], T.StructField("word", T.LongType()), T.StructField("cov", T.DoubleType())])
    kmer = F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright("word", 2 * (k - 1 - j)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for j in range(k)])
    return both.mapInArrow(run, kind).select("contig", kmer.alias("kmer"), "cov")


def sampled(seqs: DataFrame, by: str, seed: int) -> DataFrame:
    """One contig of each group, drawn by the softmax of its share of the group's bases times a quarter of the number of contigs (1 to 16)."""
    sizes = seqs.groupBy(by).agg(F.sum("len").alias("_bp"), F.count(F.lit(1)).alias("_n"))
    rows = seqs.join(sizes, by)
    logit = F.col("len") / F.col("_bp") * F.greatest(F.lit(1.0), F.least(F.lit(16.0), 0.25 * F.col("_n")))
    best = F.max_by(F.struct("contig", "seq", "len"), F.struct(F.round(logit + gumbel(F.col("contig"), seed), 9), -F.col("contig")))
    return rows.groupBy(by).agg(best.alias("x")).select(by, "x.*")


def epoch_order(rows: DataFrame, batch: int, least_steps: int, seed: int) -> DataFrame:
    """turn, at, id: the order of an epoch over ``rows(id)``: one permutation, or several if the steps of one are more than ten short of ``least_steps``."""
    n = rows.count()
    steps = n // batch
    turns = least_steps // max(steps, 1) + 1 if steps + 10 < least_steps else 1
    each = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    placed = numbered(each.withColumn("_u", uniform(F.col("id"), F.col("turn"), seed)), "turn", "_u", "id")
    return placed.select("turn", (F.col("at") - F.col("turn") * n).alias("at"), "id")


def dense_views(seqs: DataFrame, n: int, shortest: int) -> DataFrame:
    """contig, view, kind, seq, start, end: the views of a training example: the whole contig, n - 1 random parts, the whole to be masked, and the whole once more."""
    whole = lambda: F.struct(F.col("seq").alias("seq"), F.lit(0).alias("start"), F.length("seq").alias("end"))
    part = lambda i: fn_view(F.col("seq"), shortest, F.concat_ws("/", F.col("contig").cast("string"), F.lit(str(i))))
    views = [("whole", whole()), *(("part", part(i)) for i in range(1, n)), ("masked", whole()), ("whole", whole())]
    each = F.posexplode(F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("v")) for kind, v in views])).alias("view", "x")
    return seqs.select("contig", each).select("contig", "view", F.col("x.kind").alias("kind"), "x.v.seq", "x.v.start", "x.v.end")
