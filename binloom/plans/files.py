"""Queries over files: a table is written in a format's own layout and read back by its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import intervals, markers
from ..steps import folder, numbered
from . import tables as t
from .base import query


def _lines(df: DataFrame, line: Column, what: str, **options) -> str:
    path = folder(df.sparkSession, what)
    df.select(line.alias("value")).write.options(**options).text(path)
    return path


def _tab(*cols) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sequences; one in ten is named as a plasmid."""
    docs = t.load(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 10 == 0, "Plasmid_").otherwise("c_")
    return docs.select(F.concat(kind, F.col("doc_id").cast("string")).alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"), "doc_id")


_SEQ = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"


@query(f"SELECT 'c_' || doc_id AS name, length({_SEQ})::BIGINT AS len, md5({_SEQ}) AS digest FROM documents WHERE doc_id % 10 <> 0")
def fasta_scan(spark, d):
    path = folder(spark, "fasta")
    sources.write_fasta(_named(spark, d), path)
    return sources.fasta(spark, path).select("name", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


@query(f"SELECT 'c_' || doc_id AS name, length({_SEQ})::BIGINT AS len, md5({_SEQ}) AS digest FROM documents")
def fasta_gz_scan(spark, d):
    rows = _named(spark, d)
    record = F.concat(F.lit(">c_"), F.col("doc_id").cast("string"), F.lit(" made from a document\n\n"), F.lower("seq"))
    path = _lines(rows, record, "fasta-gz", compression="gzip")
    return sources.fasta(spark, path, trim_header=True).select("name", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


@query(f"SELECT 'c_' || doc_id AS name, length({_SEQ})::BIGINT AS len FROM documents")
def header_rewrite(spark, d):
    rows = _named(spark, d)
    path, out = _lines(rows, F.concat(F.lit(">c_"), F.col("doc_id").cast("string"), F.lit(" made from\ta document\n"), "seq"), "fasta"), folder(spark, "fasta")
    sources.rewrite_headers(spark, path, out)
    return sources.fasta(spark, out).select("name", F.length("seq").cast("long").alias("len"))


@query(f"WITH {t.READS}, c AS (SELECT subject, floor(quantile_cont(d, 0.975))::BIGINT AS cap FROM full_depth GROUP BY ALL) SELECT subject, round(avg(least(d, cap)), 6) AS mean, round(stddev_pop(least(d, cap)), 6) AS std FROM full_depth JOIN c USING (subject) GROUP BY ALL")
def sam_depth(spark, d):
    li = t.load(spark, d, "lineitem")
    n = F.col("l_quantity").cast("int").cast("string")
    # as many bases of the reference in four spellings; every read also once without a place
    cigar = F.when(F.col("l_linenumber") % 4 == 0, F.concat(n, F.lit("M"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("3S"), n, F.lit("="))).when(F.col("l_linenumber") % 4 == 2, F.concat(n, F.lit("M2I0D"))).otherwise(F.concat(F.lit("1H"), n, F.lit("X5S")))
    read = lambda flag: F.concat_ws("\t", F.lit("r"), F.lit(flag), F.col("l_partkey").cast("string"), (F.col("l_orderkey") % 1000 + 1).cast("string"), F.lit("60"), cigar, F.lit("*\t0\t0\t*\t*"))
    rows = li.select(F.explode(F.array(read("0"), read("4"))).alias("line")).unionByName(spark.createDataFrame([("@HD\tVN:1.6",), ("r\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*",)], "line string"))
    reads = sources.sam(spark, _lines(rows, F.col("line"), "sam")).withColumnRenamed("ref", "subject")
    hist = intervals.depth_histogram(intervals.depth_runs(reads, ["subject"]), reads.groupBy("subject").agg(F.max("en").alias("length")), ["subject"])
    return intervals.winsorised(hist, ["subject"]).select(F.col("subject").cast("long").alias("subject"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _domains(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a domain table: contig o<order>, frame <line>, accession by brand."""
    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), "p_size")
    li = t.load(spark, d, "lineitem").join(part, "l_partkey")
    return li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("orf"), F.concat(F.lit("PF"), F.regexp_replace("brand", r"\D", ""), F.lit(".1")).alias("acc"), F.col("l_quantity").cast("int").alias("q"), F.col("p_size").alias("size"), F.round("l_extendedprice").cast("int").alias("score"), "l_partkey", "l_suppkey")


def _domain_file(spark: SparkSession, d: str) -> str:
    w = lambda c: c.cast("string") if not isinstance(c, str) else F.col(c).cast("string")
    one = F.lit(1)
    fields = [w("orf"), F.lit("-"), w("l_partkey"), w("acc"), w("acc"), w("size"), F.lit("1e-12"), w("score"), F.lit("0.1"), w("l_suppkey"), w(one), F.lit("1e-5"), F.lit("1e-6"), w("score"), F.lit("0"), w(one), w("q"), w(one), w(F.col("q") + 1), w(one), w("q"), F.lit("0.9"), F.lit("a family   of proteins")]
    rows = _domains(spark, d).select(F.concat_ws("   ", *fields).alias("line")).unionByName(spark.createDataFrame([("# a comment",), ("too few fields",)], "line string"))
    return _lines(rows, F.col("line"), "domains")


_DOM = "dom AS (SELECT 'o' || l_orderkey AS contig, l_linenumber AS orf, 'PF' || regexp_replace(p_brand, '\\D', '', 'g') || '.1' AS acc, l_quantity::INT AS q, p_size AS size, round(l_extendedprice)::INT AS score, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"WITH {_DOM} SELECT acc, count(*) AS n, sum(score)::DOUBLE AS score, sum(q)::DOUBLE AS hmm_to, min('a_family_of_proteins') AS description FROM dom GROUP BY acc")
def domain_table(spark, d):
    rows = sources.domtblout(spark, _domain_file(spark, d))
    return rows.groupBy(F.col("query_accession").alias("acc")).agg(F.count(F.lit(1)).alias("n"), F.sum("dom_score").alias("score"), F.sum("hmm_to").alias("hmm_to"), F.min("description").alias("description"))


def _models(spark: SparkSession, d: str) -> str:
    """A model for each brand: thresholds GA for some, TC or NC for others, none for the rest."""
    n = F.regexp_replace("p_brand", r"\D", "").cast("int")
    kind = F.when(n % 4 == 0, "GA").when(n % 4 == 1, "TC").when(n % 4 == 2, "NC")
    brands = t.load(spark, d, "part").select("p_brand").distinct().withColumn("n", n).withColumn("kind", kind)
    line = F.concat(F.lit("HMMER3/f [3.1b2 | http://hmmer.org/]\nNAME  x\nACC   PF"), F.col("n").cast("string"), F.lit(".1\n"), F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit("    20000.00 30000.50;\n"))).otherwise(""), F.lit("STATS\n//"))
    return _lines(brands, line, "models")


_MODEL = "model AS (SELECT DISTINCT 'PF' || regexp_replace(p_brand, '\\D', '', 'g') || '.1' AS acc, regexp_replace(p_brand, '\\D', '', 'g')::INT % 4 AS k FROM part)"


@query(f"WITH {_MODEL} SELECT acc, CASE k WHEN 0 THEN 'ga' WHEN 1 THEN 'tc' WHEN 2 THEN 'nc' ELSE 'none' END AS kind, CASE WHEN k < 3 THEN 20000.0::DOUBLE END AS full, CASE WHEN k < 3 THEN 30000.5::DOUBLE END AS dom FROM model")
def model_file(spark, d):
    m = sources.hmm_models(spark, _models(spark, d))
    kind = F.when(F.col("ga").isNotNull(), "ga").when(F.col("tc").isNotNull(), "tc").when(F.col("nc").isNotNull(), "nc").otherwise("none")
    one = F.coalesce("ga", "tc", "nc")
    return m.select("acc", kind.alias("kind"), one["full"].alias("full"), one["dom"].alias("dom"))


@query(f"""WITH {_DOM}, {_MODEL}, ok AS (SELECT dom.*, k FROM dom JOIN model USING (acc) WHERE acc NOT LIKE '%5.1' AND q / size >= 0.3 AND CASE WHEN k < 3 THEN score >= 20000 AND score >= 30000.5 ELSE q / size >= 0.7 END),
h AS (SELECT DISTINCT contig, acc, orf FROM ok), i AS (SELECT *, orf - row_number() OVER (PARTITION BY contig, acc ORDER BY orf) AS g FROM h), r AS (SELECT contig, acc, g, (count(*) + 1) // 2 AS n FROM i GROUP BY ALL)
SELECT contig, acc AS gene, sum(n)::BIGINT AS n FROM r GROUP BY ALL""")
def marker_scan(spark, d):
    table = sources.domtblout(spark, _domain_file(spark, d))
    models = sources.hmm_models(spark, _models(spark, d))
    return markers.domain_incidence(table, models, models.where("acc not like '%5.1'"))


@query(f"""WITH {_DOM}, h AS (SELECT contig, acc, orf, max(q) AS q FROM dom GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY contig, acc ORDER BY orf) AS r FROM h), g AS (SELECT *, orf - r AS g, row_number() OVER (PARTITION BY contig, acc, orf - r ORDER BY orf) AS k FROM i)
SELECT contig, acc AS gene, string_agg(orf, '' ORDER BY orf) AS orf, sum(q)::DOUBLE AS target_length, min(q)::DOUBLE AS hmm_to FROM g GROUP BY contig, acc, g, (k - 1) // 2""")
def merged_hits(spark, d):
    rows = _domains(spark, d).groupBy(F.split_part("orf", F.lit("_"), F.lit(1)).alias("contig"), F.col("acc").alias("gene"), F.split_part("orf", F.lit("_"), F.lit(2)).alias("orf")).agg(F.max("q").cast("double").alias("q"))
    ends = [F.col("q").alias(c) for c in markers.ENDS]
    return markers.merged_hits(rows.select("contig", "gene", "orf", F.col("q").alias("target_length"), *ends, F.col("orf").cast("int").alias("at"))).select("contig", "gene", "orf", "target_length", "hmm_to")


@query("SELECT 'o' || l_orderkey AS contig, p_brand AS gene, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def marker_table(spark, d):
    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orf = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    rows = t.load(spark, d, "lineitem").join(part, "l_partkey").select(F.lit("bin1").alias("Bin Id"), F.col("p_brand").alias("Marker Id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(orf, F.lit("&&x_1"))).otherwise(orf).alias("Gene Id"))
    path = folder(spark, "markers")
    sources.write_tsv(rows, path, header=True)
    return sources.marker_table(spark, path)


@query("SELECT taxon, set_id, gene FROM (SELECT 'd__' || r_name AS taxon, r_regionkey FROM region) r, (SELECT DISTINCT ascii(substr(p_brand, length(p_brand), 1)) - 48 AS set_id, p_brand AS gene FROM part)")
def marker_set_file(spark, d):
    part = t.load(spark, d, "part").select("p_brand", (F.ascii(F.expr("substr(p_brand, length(p_brand), 1)")) - 48).alias("set_id")).distinct()
    sets = part.groupBy("set_id").agg(F.concat(F.lit("set(["), F.array_join(F.transform(F.sort_array(F.collect_list("p_brand")), lambda g: F.concat(F.lit("'"), g, F.lit("'"))), ", "), F.lit("])")).alias("s"))
    literal = sets.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("set_id", "s"))), lambda x: x["s"]), ", "), F.lit("]")).alias("literal"))  # five rows
    rows = t.load(spark, d, "region").select(F.concat(F.lit("d__"), "r_name").alias("taxon")).join(F.broadcast(literal))
    return sources.marker_sets(spark, _lines(rows, _tab("taxon", F.lit("lineage"), F.lit("5"), "literal"), "sets"))


def _report(spark: SparkSession, d: str, first: int) -> str:
    """A quality report with a header; the three fields begin at ``first``."""
    q = t.quality(spark, d).select(_tab(*[F.lit("x")] * first, F.concat(F.lit("b"), F.col("bin").cast("string")), "comp", "cont", F.lit("more")).alias("line"))
    return _lines(q.unionByName(spark.createDataFrame([("\t".join(["x"] * first + ["Name", "Completeness", "Contamination", "Other"]),)], "line string")), F.col("line"), "report")


_STATE = "CASE WHEN comp >= 90 AND cont <= 5 THEN 'high' WHEN comp >= 50 AND cont <= 10 THEN 'medium' ELSE 'low' END"


@query(f"WITH {t.QUALITY} SELECT 'b' || bin || '.fa' AS name, round(comp, 6) AS comp, round(cont, 6) AS cont, {_STATE} AS state FROM q")
def quality_tsv(spark, d):
    r = sources.quality_report(spark, _report(spark, d, 0), "fa")
    return r.select("name", F.round("comp", 6).alias("comp"), F.round("cont", 6).alias("cont"), "state")


@query(f"WITH {t.QUALITY} SELECT 'b' || bin AS name, round(comp, 6) AS comp, round(cont, 6) AS cont, {_STATE} AS state FROM q")
def quality_by_index(spark, d):
    r = sources.quality_report(spark, _report(spark, d, 2), columns=(2, 3, 4))
    return r.select("name", F.round("comp", 6).alias("comp"), F.round("cont", 6).alias("cont"), "state")


@query(f"WITH {t.QUALITY}, s AS (SELECT {_STATE} AS state FROM q) SELECT count(*) FILTER (state = 'high') AS high, count(*) FILTER (state = 'medium') AS medium, count(*) FILTER (state = 'low') AS low FROM s")
def quality_counts(spark, d):
    return sources.quality_counts(sources.quality_report(spark, _report(spark, d, 0)))


@query(f"WITH {t.QUALITY} SELECT 'n' || rep || '.fasta' AS rep, 's' || bin || '.fasta' AS member FROM q")
def derep_tsv(spark, d):
    q = t.quality(spark, d)
    line = _tab(F.concat(F.lit("/a/b/n"), F.col("rep").cast("string"), F.lit(".fasta")), F.concat(F.lit("s"), F.col("bin").cast("string"), F.lit(".fasta")))
    return sources.dereplication(spark, _lines(q, line, "derep"))


@query("WITH o AS (SELECT o_custkey AS c, 'o' || o_orderkey AS contig, round(o_totalprice)::BIGINT AS len FROM orders) SELECT 'group_' || c AS cluster, contig, len FROM o QUALIFY sum(len) OVER (PARTITION BY c) >= 500000")
def cluster_tsv(spark, d):
    o = t.load(spark, d, "orders").select(F.concat(F.lit("group_"), F.col("o_custkey").cast("string")).alias("cluster"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("contig"), F.round("o_totalprice").cast("long").alias("len"))
    path = folder(spark, "clusters")
    sources.write_tsv(o.select(F.concat(F.lit(">"), "contig").alias("contig"), "cluster"), path)
    return sources.clusters(spark, path, o, 500_000)


@query("SELECT l_returnflag AS run, count(*) AS n, count(DISTINCT l_orderkey) AS contigs FROM lineitem GROUP BY ALL")
def cluster_tsv_by_run(spark, d):
    rows = t.load(spark, d, "lineitem").select(F.concat(F.lit(">o"), F.col("l_orderkey").cast("string")).alias("contig"), F.concat(F.lit("group_"), F.col("l_suppkey").cast("string")).alias("cluster"), F.col("l_returnflag").alias("run"))
    path = folder(spark, "clusters")
    sources.write_tsv(rows, path, by=["run"])
    return sources.tsv(spark, path, "contig string, cluster string").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contig").alias("contigs"))


@query("SELECT 'n' || s_nationkey AS bin, 'o' || l_orderkey AS contig, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def search_tsv(spark, d):
    s = t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = t.load(spark, d, "lineitem").join(s, "l_suppkey")
    line = _tab(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("Ωo"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")), "l_partkey", F.lit("99.1"))
    return sources.protein_search(spark, _lines(rows, line, "search")).groupBy("bin", "contig").agg(F.count(F.lit(1)).alias("n"))


def _gff(spark: SparkSession, d: str) -> str:
    rows = t.load(spark, d, "lineitem").select(_tab(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.lit("Prodigal"), F.lit("CDS"), F.col("l_orderkey") % 1000 + 1, (F.col("l_orderkey") % 1000 + F.col("l_quantity")).cast("long"), F.lit("9.1"), F.lit("+"), F.lit("0"), F.lit("ID=1_1;partial=00")).alias("line"))
    head = spark.createDataFrame([("##gff-version  3",), ('# Model Data: version=Prodigal.v2.6.3;run_type=Single;model="Ab initio";gc_cont=50;transl_table=11;uses_sd=1',)], "line string")
    return _lines(rows.unionByName(head), F.col("line"), "gff")


@query("SELECT 'p' || l_partkey AS seq_id, count(*) AS genes, max(l_orderkey % 1000 + l_quantity::BIGINT) AS last, max(11) AS table_ FROM lineitem GROUP BY ALL")
def gff_scan(spark, d):
    path = _gff(spark, d)
    table = sources.translation_table(spark, path).agg(F.max("transl_table").alias("table_"))
    return sources.gff_ends(spark, path).join(F.broadcast(table))  # one row


@query("SELECT 'p' || l_partkey AS seq_id, l_orderkey % 1000 + 1 AS start, (l_orderkey % 1000 + l_quantity)::BIGINT AS end_, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey % 1000 + 1, (l_orderkey % 1000 + l_quantity)::BIGINT) - 1 AS n FROM lineitem")
def gene_counter(spark, d):
    return sources.gff(spark, _gff(spark, d)).withColumnRenamed("end", "end_")


@query("WITH p AS (SELECT DISTINCT p_brand AS id, p_size % 3 AS k, regexp_replace(p_brand, '\\D', '', 'g') AS n FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size) = 1) SELECT id, 'PF' || n AS acc, CASE WHEN k > 0 THEN 'CL' || k END AS clan, CASE WHEN k = 2 THEN 'PF1,PF2' ELSE '' END AS nested FROM p")
def clan_file(spark, d):
    p = t.load(spark, d, "part").groupBy("p_brand").agg((F.min("p_size") % 3).alias("k")).withColumn("n", F.regexp_replace("p_brand", r"\D", ""))
    line = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID   "), "p_brand", F.lit("\n#=GF AC   PF"), "n", F.lit(".7\n#=GF WK   http://example.org/a//b\n"), F.when(F.col("k") > 0, F.concat(F.lit("#=GF CL   CL"), F.col("k").cast("string"), F.lit("\n"))).otherwise(""), F.when(F.col("k") == 2, "#=GF NE   PF1;\n#=GF NE   PF2;\n").otherwise(""), F.lit("//"))
    return sources.clans(spark, _lines(p, line, "clans")).withColumn("nested", F.array_join("nested", ","))


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY ALL")
def csv_scan(spark, d):
    path = folder(spark, "csv")
    t.load(spark, d, "lineitem").select("l_returnflag", "l_partkey").write.option("header", True).option("sep", "\t").csv(path)
    return sources.tsv(spark, path, "flag string, part long", header=True).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("parts"))


@query("SELECT word, count(*) AS n, min(idx) AS idx FROM (SELECT p_type AS word, p_size AS idx FROM part) GROUP BY ALL")
def vocabulary_scan(spark, d):
    path = _lines(t.load(spark, d, "part"), _tab("p_type", "p_size"), "vocabulary")
    return sources.vocabulary_file(spark, path).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))


@query("SELECT 's.' || s_suppkey AS bin, n_name AS annotation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def annotation_round_trip(spark, d):
    n = t.load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("annotation"))
    rows = t.load(spark, d, "supplier").join(n, "s_nationkey").select(F.concat(F.lit("s."), F.col("s_suppkey").cast("string"), F.lit(".fasta")).alias("bin"), "annotation")
    path = folder(spark, "annotations")
    sources.write_annotations(rows, path)
    return sources.annotations(spark, path)


def _paf(spark: SparkSession, d: str) -> str:
    """Alignments of line items, a contig for each order, by line; those of one supplier go to a mobile element."""
    s = t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = t.load(spark, d, "lineitem").join(s, "l_suppkey")
    n = F.col("l_quantity").cast("long")
    subject = F.when(F.col("l_suppkey") % 10 == 3, F.concat(F.lit("RNODE|length_"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("s_nationkey").cast("string"), F.lit("|p"), F.col("l_partkey").cast("string")))
    st = F.col("l_orderkey") % 1000
    line = _tab(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")), F.lit("50"), F.lit("0"), n, F.lit("+"), subject, F.lit("2000"), st, st + n, n, n, F.lit("60"))
    return _lines(rows, line, "paf")


_PAF = "paf AS (SELECT 'o' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey AS contig, 'g' || s_nationkey AS genome, 'g' || s_nationkey || '|p' || l_partkey AS subject, l_orderkey % 1000 AS st, l_orderkey % 1000 + l_quantity::BIGINT AS en FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 10 <> 3 QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey) = 1)"


@query(f"WITH {_PAF} SELECT contig, genome, subject, st, en FROM paf")
def paf_scan(spark, d):
    return sources.paf(spark, _paf(spark, d), 1.1).join(_single(spark, d), "contig", "left_semi").select("contig", "genome", "subject", "st", "en")


def _single(spark: SparkSession, d: str) -> DataFrame:
    li = t.load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("contig"))


@query(f"WITH {_PAF} SELECT contig, genome, subject, st, en FROM paf")
def truth_scan(spark, d):
    rows = sources.paf(spark, _paf(spark, d)).join(_single(spark, d), "contig", "left_semi")
    path = folder(spark, "truth")
    # closed intervals, twice: a shorter one of each contig doesn't count
    closed = rows.select("contig", "genome", "subject", "st", (F.col("en") - 1).alias("en"))
    sources.write_truth(closed.unionByName(closed.withColumn("en", F.col("st"))).repartition(3), path)
    return sources.truth(spark, path)


@query(f"WITH {_PAF} SELECT contig AS SEQUENCEID, 50::BIGINT AS SEQ_LENGTH, genome AS GENOMEID, len::BIGINT AS GEN_LENGTH FROM paf JOIN (SELECT 'g' || n_nationkey AS genome, 1000 + n_nationkey AS len FROM nation) USING (genome)")
def biobox_round_trip(spark, d):
    genomes = t.load(spark, d, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("genome"), (F.col("n_nationkey") + 1000).alias("len"))
    rows, path = sources.paf(spark, _paf(spark, d)).join(_single(spark, d), "contig", "left_semi"), folder(spark, "biobox")
    sources.write_biobox(rows, genomes, path)
    return sources.tsv(spark, path, "SEQUENCEID string, SEQ_LENGTH long, GENOMEID string, GEN_LENGTH long", header=True)


@query("SELECT 's' || s_suppkey AS genome, n_name AS species, r_name AS genus FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def taxonomy_scan(spark, d):
    r = t.load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    n = t.load(spark, d, "nation").join(r, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    rows = t.load(spark, d, "supplier").join(n, "s_nationkey")
    return sources.taxonomy(spark, _lines(rows, _tab(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "n_name", "r_name"), "taxonomy"), ["species", "genus"])


@query("SELECT 'S' || (o_orderkey % 5) || 'C' || 'bin' || o_custkey AS bin, 'S' || (o_orderkey % 5) || 'C' || o_orderkey AS contig FROM orders")
def bins_scan(spark, d):
    rows = t.load(spark, d, "orders")
    contig = F.concat(F.lit("S"), (F.col("o_orderkey") % 5).cast("string"), F.lit("C"), F.col("o_orderkey").cast("string"))
    return sources.bins(spark, _lines(rows, _tab(F.concat(F.lit("bin"), F.col("o_custkey").cast("string")), contig), "bins"), "C")


@query(f"WITH {t.QUALITY}, s AS (SELECT *, CASE {_STATE} WHEN 'high' THEN 'HighQuality' WHEN 'medium' THEN 'MediumQuality' ELSE 'LowQuality' END AS state FROM q) SELECT (bin % 4)::INT AS sample, 'b' || bin AS bin, round(comp / 100, 6) AS f1, state, 'g' || rep AS genome FROM s WHERE state <> 'LowQuality'")
def all_info_scan(spark, d):
    q = t.quality(spark, d)
    state = F.when((F.col("comp") >= 90) & (F.col("cont") <= 5), "HighQuality").when((F.col("comp") >= 50) & (F.col("cont") <= 10), "MediumQuality").otherwise("LowQuality")
    line = _tab(F.concat((F.col("bin") % 4).cast("string"), F.lit("-b"), F.col("bin").cast("string")), F.round(F.col("comp") / 100, 6), F.lit("0.5"), F.lit("0.25"), state, F.concat(F.lit("g"), F.col("rep").cast("string")))
    return sources.all_info(spark, _lines(q, line, "info")).select("sample", "bin", "f1", "state", "genome")


@query("SELECT 'g' || s_suppkey AS genome, round(sum(l_quantity)::DOUBLE, 3) AS abundance FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def abundance_scan(spark, d):
    a = t.load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"))
    of = sources.abundances(spark, _lines(a, _tab(F.concat(F.lit("Otu"), F.col("l_suppkey").cast("string")), "a"), "abundance"))
    ids = sources.genome_ids(spark, _lines(t.load(spark, d, "supplier"), _tab(F.concat(F.lit("Otu"), F.col("s_suppkey").cast("string")), F.lit("x"), F.concat(F.lit("/genomes/g"), F.col("s_suppkey").cast("string"), F.lit(".fa"))), "ids"))
    return of.join(ids, "id").select("genome", F.round("abundance", 3).alias("abundance"))


@query("SELECT source AS bin, 'c_' || doc_id AS contig FROM documents")
def bin_folder(spark, d):
    docs = t.load(spark, d, "documents").select("source", F.concat(F.lit(">c_"), F.col("doc_id").cast("string"), F.lit(" x\nACGT")).alias("value"))
    path = folder(spark, "bins")
    docs.repartition("source").write.partitionBy("source").text(path)
    return sources.bin_parts(spark, path, "source")


@query(f"SELECT source AS genome, sum(length({_SEQ}))::BIGINT AS len FROM documents GROUP BY ALL")
def genome_lengths(spark, d):
    rows = t.load(spark, d, "documents").select(F.concat("source", F.lit("|"), F.col("doc_id").cast("string")).alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    path = folder(spark, "genomes")
    sources.write_fasta(rows, path)
    return sources.genome_lengths(sources.fasta(spark, path))


@query("SELECT 'o' || l_orderkey AS contig, count(DISTINCT l_linenumber) AS orfs FROM lineitem GROUP BY ALL")
def orf_groups(spark, d):
    rows = t.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    path = _lines(rows, F.concat(F.lit(">o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(" # 1 # 9 # ID=1;partial=00\nMKV*")), "genes")
    return sources.orf_groups(spark, path).groupBy("contig").agg(F.count(F.lit(1)).alias("orfs"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1")
def complete_genes(spark, d):
    rows = t.load(spark, d, "lineitem")
    path = _lines(rows, F.concat(F.lit(">o"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 1, " # ID=1;partial=00;x").otherwise(" # ID=1;partial=10;x"), F.lit("\nMKV*")), "genes")
    return sources.complete_genes(spark, path).agg(F.sum("n").alias("n"))


@query("SELECT 'o' || o_orderkey AS contig, round(o_totalprice, 2) AS a, (o_custkey % 100)::DOUBLE AS b FROM orders")
def depth_tsv(spark, d):
    o = t.load(spark, d, "orders")
    head = spark.createDataFrame([("contigName\tcontigLen\ttotalAvgDepth\ta\ta-var\tb\tb-var",)], "line string")
    rows = o.select(_tab(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.lit("1000"), F.lit("1"), "o_totalprice", F.lit("0"), F.col("o_custkey") % 100, F.lit("0")).alias("line"))
    depths = sources.depth_table(spark, _lines(head.unionByName(rows), F.col("line"), "depth"), many=True)
    return depths.select("contig", F.round(F.col("depth")[0], 2).alias("a"), F.col("depth")[1].alias("b"))


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS at, 'o' || o_orderkey AS contig, (o_custkey % 100)::DOUBLE AS depth FROM orders")
def depth_in_order(spark, d):
    o = t.load(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("contig"), F.col("o_custkey").alias("c"))
    seqs = o.select("contig", F.col("key").alias("at"))
    depths = o.select("contig", (F.col("c") % 100).cast("double").alias("depth"))
    return numbered(sources.in_order(depths, seqs).withColumnRenamed("at", "key"), "key").drop("key")


@query(f"SELECT 'Contig_' || (row_number() OVER (ORDER BY name) - 1) || '_' || length(seq) AS name, md5(seq) AS digest FROM (SELECT 'd' || lpad(doc_id::VARCHAR, 9, '0') AS name, {_SEQ} AS seq FROM documents)")
def renamed_fasta(spark, d):
    rows = t.load(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    path = folder(spark, "renamed")
    sources.write_renamed_fasta(rows, path, per_file=100)
    return sources.fasta(spark, path).select("name", F.md5("seq").alias("digest"))


@query(f"WITH {t.QUALITY}, b AS (SELECT bin, comp, cont, {_STATE} AS state, (bin * 7919 % 5000)::BIGINT AS bp FROM q) SELECT 'Bin_' || (row_number() OVER (ORDER BY comp DESC, cont, bin) - 1) AS name, bin, state, bp FROM b WHERE bp >= 1000")
def selected_bins(spark, d):
    from ..functions import quality_state

    q = t.quality(spark, d).select("bin", "comp", "cont", quality_state(F.col("comp"), F.col("cont")).alias("state"))
    path = folder(spark, "selected")
    sources.write_tsv(sources.selected(q, q.select("bin", (F.col("bin") * 7919 % 5000).alias("bp")), least_bp=1000), path)
    return sources.tsv(spark, path, "name string, bin long, comp double, cont double, state string, bp long").select("name", "bin", "state", "bp")


@query(f"WITH {t.QUALITY}, k AS (SELECT bin, round(comp, 6) AS comp, {_STATE} AS state FROM q WHERE NOT (abs(comp - scg_comp) > 40 AND scg_comp < 10)), m AS (SELECT l_suppkey AS bin, count(DISTINCT l_partkey) AS contigs FROM lineitem GROUP BY ALL) SELECT bin, comp, state, coalesce(contigs, 0)::BIGINT AS contigs FROM k LEFT JOIN m USING (bin)")
def final_table(spark, d):
    from ..functions import quality_state

    q = t.quality(spark, d).withColumn("state", quality_state(F.col("comp"), F.col("cont")))
    members = t.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("bin"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("contig")).distinct()
    path = folder(spark, "final")
    sources.final_table(q, members.select(F.col("contig").alias("name"), F.lit("ACGT").alias("seq")).distinct(), members, path)
    info = sources.tsv(spark, f"{path}/info", "bin long, comp double, cont double, state string")
    bins = sources.bin_parts(spark, f"{path}/bins").groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("contigs"))
    return info.join(bins, "bin", "left").select("bin", F.round("comp", 6).alias("comp"), "state", F.coalesce("contigs", F.lit(0).cast("long")).alias("contigs"))


@query("SELECT 'b' || o_custkey AS bin, count(DISTINCT (l_orderkey, l_linenumber)) AS orfs, count(*) AS found FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def redealt_bins(spark, d):
    members = t.load(spark, d, "orders").select(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("bin"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("contig"))
    contig = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    orf = F.concat(contig, F.lit("_"), F.col("l_linenumber").cast("string"))
    li = t.load(spark, d, "lineitem")
    path = folder(spark, "redealt")
    sources.write_bins(members, li.select(contig.alias("contig"), orf.alias("orf"), F.lit("MKV").alias("seq")).distinct(), li.select(contig.alias("contig"), F.concat_ws("\t", orf, F.col("l_partkey").cast("string")).alias("line")), path)
    orfs = sources.bin_parts(spark, f"{path}/faa").groupBy("bin").agg(F.count(F.lit(1)).alias("orfs"))
    found = sources.protein_search(spark, f"{path}/search").groupBy("bin").agg(F.count(F.lit(1)).alias("found"))
    return orfs.join(found, "bin")


@query("WITH b AS (SELECT unnest(['A','T','G','C']) AS x) SELECT a.x || b.x || c.x AS kmer, 1::BIGINT AS n FROM b a, b b, b c")
def map_table(spark, d):
    """A map kept as a table between steps: the words of a vocabulary."""
    from ..operators import sequences
    from ..steps import written

    words = written(sequences.vocabulary(spark, 3).select("kmer"))
    return words.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
