"""The logical tables of the engine, derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """contig, genome, bin, subject, st, en: line items as alignments; genome is the supplier's nation, bin the customer's."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    genome = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genome"))
    order = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bins = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("bin"))
    rows = li.join(genome, "l_suppkey").join(order.join(bins, "o_custkey"), "l_orderkey")
    st = F.col("l_orderkey") % 1000
    return rows.select(F.col("l_orderkey").alias("contig"), "genome", "bin", F.col("l_partkey").alias("subject"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en"))


ALIGNED = """aln AS (SELECT l_orderkey AS contig, s_nationkey AS genome, c_nationkey AS bin, l_partkey AS subject, l_orderkey % 1000 AS st, l_orderkey % 1000 + l_quantity::BIGINT AS en
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
pos AS (SELECT DISTINCT genome, bin, subject, unnest(range(st, en)) AS p FROM aln),
tpx AS (SELECT genome, bin, count(*) AS tp FROM pos GROUP BY ALL),
gbx AS (SELECT genome, count(*) AS genome_bp FROM (SELECT DISTINCT genome, subject, p FROM pos) GROUP BY ALL),
bbx AS (SELECT bin, sum(tp)::BIGINT AS bin_bp FROM tpx GROUP BY ALL),
cnt AS (SELECT genome, bin, tp, genome_bp, bin_bp, tp / genome_bp AS recall, tp / bin_bp AS prec, 2 * tp / (genome_bp + bin_bp) AS f1 FROM tpx JOIN gbx USING (genome) JOIN bbx USING (bin))"""

READS = """reads AS (SELECT l_partkey AS subject, l_orderkey % 1000 AS st, l_orderkey % 1000 + l_quantity::BIGINT AS en FROM lineitem),
depth AS (SELECT subject, p, count(*) AS d FROM (SELECT subject, unnest(range(st, en)) AS p FROM reads) GROUP BY ALL),
span AS (SELECT subject, max(en) AS length FROM reads GROUP BY ALL),
full_depth AS (SELECT s.subject, s.p, coalesce(d, 0) AS d FROM (SELECT subject, unnest(range(0, length)) AS p FROM span) s LEFT JOIN depth USING (subject, p))"""


def reads(spark: SparkSession, d: str) -> DataFrame:
    st = F.col("l_orderkey") % 1000
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en"))


CONTIGS = "contigs AS (SELECT doc_id AS contig, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq, length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) AS len FROM documents)"
KMERS = CONTIGS + """, km AS (SELECT contig, source, i, substr(seq, i, 4) AS k FROM (SELECT contig, source, seq, unnest(range(1, len - 2)) AS i FROM contigs WHERE len >= 4)),
ck AS (SELECT contig, source, i, k, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM km)"""

#: Candidate bins of several methods: suppliers grouped by nation, with completeness and contamination from their balances.
QUALITY = """q AS (SELECT 'm' || (s_suppkey % 6) AS method, s_suppkey AS bin, s_nationkey AS rep, (abs(s_acctbal) * 7) % 101 AS comp, (abs(s_acctbal) * 3) % 13 AS cont, (abs(s_acctbal) * 11) % 101 AS scg_comp FROM supplier)"""


def quality(spark: SparkSession, d: str) -> DataFrame:
    bal = F.abs(F.col("s_acctbal"))
    return load(spark, d, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 6).cast("string")).alias("method"), F.col("s_suppkey").alias("bin"), F.col("s_nationkey").alias("rep"), (bal * 7 % 101).alias("comp"), (bal * 3 % 13).alias("cont"), (bal * 11 % 101).alias("scg_comp"))


def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    """bin (nation of the order's customer), gene (brand), n"""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    order = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("bin"))
    return li.join(order, "l_orderkey").join(part, "l_partkey").groupBy("bin", "gene").agg(F.count(F.lit(1)).alias("n"))


MARKERS = """mk AS (SELECT o_custkey AS bin, p_brand AS gene, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def marker_sets(spark: SparkSession, d: str, k: int) -> DataFrame:
    return load(spark, d, "part").select(F.expr(f"cast(crc32(p_brand) % {k} as int)").alias("set_id"), F.col("p_brand").alias("gene")).distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as domain hits; the last columns make ties unique."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("acc"), "p_size")
    li = load(spark, d, "lineitem").join(part, "l_partkey")
    return li.select("acc", F.col("l_orderkey").alias("scaffold"), F.col("l_linenumber").alias("orf"), F.col("l_extendedprice").alias("dom"), (F.col("l_quantity") / F.col("p_size")).alias("cov"), F.when(F.col("l_discount") < 0.05, F.lit(1e-12)).otherwise(F.lit(1e-3)).alias("evalue"), "l_partkey", "l_suppkey", "p_size")


HITS = """h AS (SELECT p_brand AS acc, l_orderkey AS scaffold, l_linenumber AS orf, l_extendedprice AS dom, l_quantity / p_size AS cov, CASE WHEN l_discount < 0.05 THEN 1e-12 ELSE 1e-3 END AS evalue, l_partkey, l_suppkey, p_size FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
PAIRS = VECTORS + """, pr AS (SELECT a.id AS src, b.id AS dst, a.label AS la, b.label AS lb, list_sum(list_transform(range(1, 65), lambda i: (a.vec[i] - b.vec[i]) * (a.vec[i] - b.vec[i]))) AS d2 FROM v a, v b WHERE a.id <> b.id)"""
NEAR = PAIRS + ", nn AS (SELECT src, dst, d2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d2, 9), dst) AS r FROM pr) WHERE r <= 5)"
