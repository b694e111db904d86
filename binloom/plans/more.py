"""Queries of joins, depth features, random views, losses and selection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import depths, evaluation, intervals, losses, markers, selection, sequences, vectors
from . import tables as t
from .base import query

# --- depths of several samples

_FILES = """rd AS (SELECT l_linenumber % 3 AS file, l_partkey AS contig, l_orderkey % 1000 AS st, l_orderkey % 1000 + l_quantity::BIGINT AS en FROM lineitem),
dp AS (SELECT file, contig, p, count(*) AS d FROM (SELECT file, contig, unnest(range(st, least(en, 1020))) AS p FROM rd) GROUP BY ALL),
hit AS (SELECT DISTINCT file, contig FROM dp),
fd AS (SELECT h.file, h.contig, coalesce(d, 0) AS d FROM (SELECT file, contig, unnest(range(0, 1020)) AS p FROM hit) h LEFT JOIN dp USING (file, contig, p)),
cap AS (SELECT file, contig, floor(quantile_cont(d, 0.975))::BIGINT AS cap FROM fd GROUP BY ALL),
st AS (SELECT file, contig, avg(least(d, cap)) AS mean, stddev_pop(least(d, cap)) AS std FROM fd JOIN cap USING (file, contig) GROUP BY ALL),
df AS (SELECT f.file, p_partkey AS contig, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS file) f LEFT JOIN st ON st.file = f.file AND st.contig = p_partkey),
top AS (SELECT file, max(mean) + 1e-5::DOUBLE AS mean, max(std) + 1e-5::DOUBLE AS std FROM df GROUP BY file),
mx AS (SELECT file, CASE WHEN (SELECT max(mean) FROM top) > 0.05 THEN mean / 2 ELSE mean END AS mean, CASE WHEN (SELECT max(std) FROM top) > 1000 THEN std / 2 ELSE std END AS std FROM top)"""


def _depths(spark: SparkSession, d: str) -> DataFrame:
    li = t.load(spark, d, "lineitem")
    st = F.col("l_orderkey") % 1000
    reads = li.select((F.col("l_linenumber") % 3).alias("file"), F.col("l_partkey").alias("contig"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en"))
    contigs = t.load(spark, d, "part").select(F.col("p_partkey").alias("contig"), F.lit(1020).cast("long").alias("len"))
    return depths.contig_depths(reads, contigs, spark.createDataFrame([(0,), (1,), (2,)], "file int"))


@query(f"WITH {_FILES} SELECT file, contig, round(mean, 6) AS mean, round(std, 6) AS std FROM df")
def depth_features(spark, d):
    return _depths(spark, d).select("file", "contig", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _limits(spark: SparkSession, d: str) -> DataFrame:
    """The largest means, halved as if 0.05 were much; deviations by the usual limit."""
    x = _depths(spark, d)
    return depths.maxima(x, 0.05).select("file", "mean").join(depths.maxima(x).select("file", "std"), "file")


@query(f"WITH {_FILES} SELECT file, round(mean, 6) AS mean, round(std, 6) AS std FROM mx")
def depth_maxima(spark, d):
    return _limits(spark, d).select("file", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_COMP = f"""{t.KMERS}, rd AS (SELECT l_linenumber % 3 AS file, l_partkey AS contig, l_orderkey % 1000 AS st, l_orderkey % 1000 + l_quantity::BIGINT AS en FROM lineitem),
dp AS (SELECT file, contig, p, count(*) AS d FROM (SELECT file, contig, unnest(range(st, en)) AS p FROM rd) GROUP BY ALL),
x AS (SELECT contig, kmer, unnest([i - 1, i, i + 1, i + 2]) AS p FROM ck),
cv AS (SELECT file, contig, kmer, sum(d) / (4 * any_value(len)) AS cov FROM x JOIN dp USING (contig, p) JOIN contigs USING (contig) GROUP BY ALL)"""


def _composition(spark: SparkSession, d: str) -> DataFrame:
    li = t.load(spark, d, "lineitem")
    st = F.col("l_orderkey") % 1000
    reads = li.select((F.col("l_linenumber") % 3).alias("file"), F.col("l_partkey").alias("contig"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en"))
    docs = sequences.contigs(t.load(spark, d, "documents"))
    runs = intervals.depth_runs(reads, ["file", "contig"])
    files = [0, 1, 2]
    parts = [sequences.coverage_composition(docs, runs.where(F.col("file") == f).drop("file"), 4).withColumn("file", F.lit(f)) for f in files]  # a pass a sample
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_COMP}, top AS (SELECT file, max(cov) / 2 AS top FROM cv GROUP BY file) SELECT file, kmer, count(*) AS n, round(sum(cov / top), 6) AS scaled FROM cv JOIN top USING (file) GROUP BY ALL")
def scaled_composition(spark, d):
    from ..steps import written

    comp = written(_composition(spark, d))
    return depths.scaled_composition(comp, depths.composition_maxima(comp)).groupBy("file", "kmer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cov"), 6).alias("scaled"))


@query(f"WITH {_FILES} SELECT df.file, contig, round(df.mean / 7.5, 6) AS mean, round(df.std / mx.std, 6) AS std FROM df JOIN mx USING (file)")
def scaled_depths(spark, d):
    tops = spark.createDataFrame([(f, 7.5) for f in range(3)], "file int, top double")
    return depths.scaled(_depths(spark, d), tops, _limits(spark, d)).select("file", "contig", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# --- joins


@query(f"WITH {t.CONTIGS} SELECT contig, len, round(embedding[1]::DOUBLE, 6) AS x FROM contigs JOIN embeddings ON vec_id = contig WHERE len >= 100")
def contig_embeddings(spark, d):
    docs = sequences.contigs(t.load(spark, d, "documents")).where("len >= 100")
    return docs.join(t.vectors(spark, d).withColumnRenamed("id", "contig"), "contig").select("contig", "len", F.round(F.col("vec")[0], 6).alias("x"))


@query("SELECT l_orderkey AS contig, count(*) AS hits FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def hits_of_contigs(spark, d):
    chosen = t.load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.load(spark, d, "lineitem").join(chosen, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("contig")).agg(F.count(F.lit(1)).alias("hits"))


@query("WITH g AS (SELECT p_brand AS gene, l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT gene FROM g GROUP BY gene ORDER BY count(DISTINCT id) DESC, gene LIMIT 1) SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE vec_id IN (SELECT id FROM g JOIN m USING (gene))")
def seed_contigs(spark, d):
    """Rows of the contigs that carry the commonest marker; most of these contigs have no vector."""
    from ..operators import clustering

    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    genes = t.load(spark, d, "lineitem").join(part, "l_partkey").select("gene", F.col("l_orderkey").alias("id")).distinct()
    top = genes.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gene").limit(1).select("gene")
    return clustering.seed_rows(t.vectors(spark, d), genes.join(F.broadcast(top), "gene")).select("id", F.round(F.col("vec")[0], 6).alias("x"))  # one row


@query(f"WITH {t.QUALITY} SELECT a.rep, a.bin AS member, round(a.comp, 6) AS comp, round(b.scg_comp, 6) AS scg_comp, round(r.comp, 6) AS rep_comp FROM q a JOIN q b ON b.bin = a.bin JOIN q r ON r.bin = a.rep")
def member_qualities(spark, d):
    q = t.quality(spark, d)
    pairs, external, own = q.select("rep", F.col("bin").alias("member")), q.select(F.col("bin").alias("member"), "comp"), q.select(F.col("bin").alias("member"), "scg_comp")
    both = selection.with_qualities(pairs, external, own)
    rep = q.select(F.col("bin").alias("rep"), F.round("comp", 6).alias("rep_comp"))
    return both.join(rep, "rep").select("rep", "member", F.round("comp", 6).alias("comp"), F.round("scg_comp", 6).alias("scg_comp"), "rep_comp")


@query("WITH a AS (SELECT s_nationkey AS genome, sum(l_quantity) AS ab FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), r AS (SELECT genome, row_number() OVER (ORDER BY ab DESC, genome) AS r, count(*) OVER () AS n FROM a) SELECT CASE WHEN r <= n // 2 THEN 'high' ELSE 'low' END AS half, count(DISTINCT l_orderkey) AS contigs, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN r ON genome = s_nationkey GROUP BY ALL")
def contig_halves(spark, d):
    from . import abundance_halves

    s = t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genome"))
    rows = t.load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").join(abundance_halves(spark, d), "genome")
    return rows.groupBy("half").agg(F.countDistinct("l_orderkey").alias("contigs"), F.count(F.lit(1)).alias("n"))


# --- rules


@query("WITH g AS (SELECT DISTINCT p_brand AS gene, l_orderkey AS contig FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT gene, sum(round(o_totalprice)::BIGINT)::BIGINT AS bp, count(*) AS n FROM g JOIN orders ON o_orderkey = contig GROUP BY 1), a AS (SELECT 'all' AS of, * FROM s UNION ALL SELECT 'chosen', * FROM s WHERE gene LIKE '%1') SELECT of, gene, bp, n FROM a QUALIFY row_number() OVER (PARTITION BY of ORDER BY bp DESC, gene) = 1")
def marker_longest_contigs(spark, d):
    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    genes = t.load(spark, d, "lineitem").join(part, "l_partkey").select("gene", F.col("l_orderkey").alias("contig"))
    lengths = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("contig"), F.round("o_totalprice").cast("long").alias("len"))
    chosen = part.where("gene like '%1'").select("gene").distinct()
    top = lambda of, only: markers.longest_marker(genes, lengths, only).withColumn("of", F.lit(of))
    return top("all", None).unionByName(top("chosen", chosen)).select("of", "gene", "bp", "n")


_RUNS = """m AS (SELECT bin, 'Leiden_embMat0_maxedges_' || (100 - 25 * (bin % 2)) || '_partgraphRatio_' || (50 + 25 * (bin % 3)) || '_resolution_' || (bin % 2 + 1) || '.0_bandwidth_0.' || ((bin // 2) % 4) || '.tsv' AS method, comp, cont FROM q),
k AS (SELECT array_to_string(list_slice(string_split(method, '_'), 1, 8), '_') AS grp, method, count(*) FILTER (comp >= 90 AND cont <= 5) AS n905, count(*) FILTER (comp > 50 AND cont < 10) + count(*) FILTER (comp > 70 AND cont < 10) + count(*) FILTER (comp > 90 AND cont < 10) + count(*) FILTER (comp > 50 AND cont < 5) + count(*) FILTER (comp > 70 AND cont < 5) + count(*) FILTER (comp >= 90 AND cont <= 5) AS total FROM m GROUP BY ALL)"""


@query(f"WITH {t.QUALITY}, {_RUNS}, a AS (SELECT grp, method FROM k QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n905 DESC, method) = 1), b AS (SELECT grp, method FROM k QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC, method) = 1) SELECT * FROM a UNION SELECT * FROM b")
def best_runs(spark, d):
    b = F.col("bin")
    name = F.concat(F.lit("Leiden_embMat0_maxedges_"), (100 - 25 * (b % 2)).cast("string"), F.lit("_partgraphRatio_"), (50 + 25 * (b % 3)).cast("string"), F.lit("_resolution_"), (b % 2 + 1).cast("string"), F.lit(".0_bandwidth_0."), F.expr("bin div 2 % 4").cast("string"), F.lit(".tsv"))
    stats = selection.method_stats(t.quality(spark, d).withColumn("method", name))
    return selection.best_methods(stats.withColumn("grp", selection.run_group(F.col("method"))), "grp")


@query("WITH k AS (SELECT substr(s, i, 4) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 2)) AS i FROM (SELECT replace(upper(text), 'N', 'A') AS s FROM documents) WHERE length(s) >= 4)) SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]{4}') GROUP BY 1")
def kmer_rule(spark, d):
    seqs = t.load(spark, d, "documents").select(fn.sequence(F.col("text")).alias("seq"))
    return sequences.kmer_counts(seqs, 4)


_TABLES = "rd AS (SELECT l_suppkey AS bin, l_linenumber % 2 AS tab, l_orderkey % 200 AS st, l_orderkey % 200 + l_quantity::BIGINT AS en FROM lineitem), cb AS (SELECT bin, tab, count(DISTINCT p) AS n FROM (SELECT bin, tab, unnest(range(st, en)) AS p FROM rd) GROUP BY ALL), dn AS (SELECT bin, coalesce(max(n) FILTER (tab = 0), 0) / 240 AS d4, coalesce(max(n) FILTER (tab = 1), 0) / 265 AS d11 FROM cb GROUP BY bin)"


@query(f"WITH {_TABLES} SELECT bin, round(d4, 9) AS d4, round(d11, 9) AS d11, CASE WHEN d4 - d11 > 0.05 AND d4 > 0.7 THEN 4 ELSE 11 END AS code FROM dn")
def coding_table(spark, d):
    st = F.col("l_orderkey") % 200
    rows = t.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("bin"), (F.col("l_linenumber") % 2).alias("tab"), F.lit(0).alias("subject"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en"))
    both = intervals.breadth(rows, ["bin", "tab"]).groupBy("bin").pivot("tab", [0, 1]).agg(F.max("covered")).fillna(0)
    of = both.select("bin", (F.col("0") / 240).alias("d4"), (F.col("1") / 265).alias("d11"))
    return of.select("bin", F.round("d4", 9).alias("d4"), F.round("d11", 9).alias("d11"), fn.coding_table(F.col("d4"), F.col("d11")).alias("code"))


@query("SELECT doc_id, length(seq) >= 200 AND length(seq) - length(replace(seq, 'N', '')) <= 0.2 * length(seq) AS ok FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents)")
def sample_filter(spark, d):
    seq = F.regexp_replace(F.upper("text"), "[^ACGTN]", "")
    return t.load(spark, d, "documents").select("doc_id", fn.sample_ok(seq, 200).alias("ok"))


# --- evaluation


@query("WITH a AS (SELECT DISTINCT c_nationkey AS bin, l_orderkey AS contig, s_nationkey AS genome, l_partkey AS subject FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey), b AS (SELECT bin, sum(1000 + contig % 977)::BIGINT AS bin_bp FROM (SELECT DISTINCT bin, contig FROM a) GROUP BY 1), g AS (SELECT genome, sum(2000 + subject % 13)::BIGINT AS genome_bp FROM (SELECT DISTINCT genome, subject FROM a) GROUP BY 1) SELECT 'bin' AS of, bin AS id, bin_bp AS bp FROM b UNION ALL SELECT 'genome', genome, genome_bp FROM g")
def breadth_by_length(spark, d):
    a = t.aligned(spark, d)
    bins, genomes = evaluation.bin_lengths(a.withColumn("contig_len", 1000 + F.col("contig") % 977)), evaluation.genome_lengths(a.withColumn("subject_len", 2000 + F.col("subject") % 13))
    return bins.select(F.lit("bin").alias("of"), F.col("bin").alias("id"), F.col("bin_bp").alias("bp")).unionByName(genomes.select(F.lit("genome").alias("of"), F.col("genome").alias("id"), F.col("genome_bp").alias("bp")))


_GRID = "grid AS (SELECT r.x AS min_recall, p.x AS min_precision FROM (SELECT unnest([0.01, 0.03, 0.05])::DOUBLE AS x) r, (SELECT unnest([0.01, 0.03, 0.05])::DOUBLE AS x) p)"


@query(f"WITH {t.ALIGNED}, {_GRID}, h AS (SELECT min_recall, min_precision, genome, n_regionkey AS region FROM grid JOIN cnt ON recall >= min_recall AND prec >= min_precision JOIN nation ON n_nationkey = genome), c AS (SELECT min_recall, min_precision, count(DISTINCT genome) AS g, count(DISTINCT region) AS r, count(DISTINCT region % 2) AS k FROM h GROUP BY ALL) SELECT grid.min_recall, grid.min_precision, rank, coalesce(CASE rank WHEN 'genome' THEN g WHEN 'region' THEN r ELSE k END, 0)::BIGINT AS n FROM grid LEFT JOIN c USING (min_recall, min_precision), (SELECT unnest(['genome', 'region', 'side']) AS rank)")
def tax_ranks(spark, d):
    ranks = t.load(spark, d, "nation").select(F.col("n_nationkey").alias("genome"), F.col("n_regionkey").alias("region"), (F.col("n_regionkey") % 2).alias("side"))
    scored = evaluation.scores(evaluation.overlap(t.aligned(spark, d)))
    return evaluation.rank_grid(scored, ranks, ["region", "side"], [0.01, 0.03, 0.05], [0.01, 0.03, 0.05])


@query(f"WITH {t.ALIGNED}, h AS (SELECT genome, recall, prec, n_regionkey AS region FROM cnt JOIN nation ON n_nationkey = genome), x AS (SELECT unnest([0.01, 0.03, 0.05])::DOUBLE AS r) SELECT 'genome' AS rank, r AS min_recall, count(DISTINCT genome) FILTER (recall >= r AND prec >= 0.03) AS n FROM x, h GROUP BY ALL UNION ALL SELECT 'region', r, count(DISTINCT region) FILTER (recall >= r AND prec >= 0.03) FROM x, h GROUP BY ALL")
def threshold_summary(spark, d):
    ranks = t.load(spark, d, "nation").select(F.col("n_nationkey").alias("genome"), F.col("n_regionkey").alias("region"))
    scored = evaluation.scores(evaluation.overlap(t.aligned(spark, d)))
    return evaluation.rank_grid(scored, ranks, ["region"], [0.01, 0.03, 0.05], [0.03]).drop("min_precision")


# --- sets


@query("WITH c AS (SELECT o_custkey AS cluster, o_orderkey AS contig, o_orderkey % 3 AS part, o_orderstatus = 'O' AS bare FROM orders), s AS (SELECT DISTINCT cluster, part FROM c WHERE NOT bare) SELECT cluster, part, contig FROM c WHERE NOT bare UNION ALL SELECT s.cluster, s.part, c.contig FROM s JOIN c USING (cluster) WHERE bare")
def split_with_unassigned(spark, d):
    o = t.load(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("contig"), (F.col("o_orderkey") % 3).alias("part"), (F.col("o_orderstatus") == "O").alias("bare"))
    return selection.with_unassigned(o.where("not bare").select("cluster", "part", "contig"), o.where("bare").select("cluster", "contig"))


@query("WITH g AS (SELECT DISTINCT p_brand AS gene, p_size % 3 AS clan FROM part), i AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size = 1) SELECT DISTINCT gene FROM g WHERE clan IN (SELECT clan FROM g JOIN i USING (gene)) AND gene NOT IN (SELECT gene FROM i)")
def clan_rest(spark, d):
    part = t.load(spark, d, "part")
    genes = part.select(F.col("p_brand").alias("gene"), (F.col("p_size") % 3).alias("clan")).distinct()
    return markers.rest_of_clans(genes, part.where("p_size = 1").select(F.col("p_brand").alias("gene")).distinct())


@query("WITH r AS (SELECT l_linenumber AS file, l_orderkey AS contig, l_partkey AS hit FROM lineitem), m AS (SELECT contig, max(file) AS file FROM r GROUP BY 1) SELECT contig, file, count(*) AS hits FROM r JOIN m USING (contig, file) GROUP BY ALL")
def last_file_wins(spark, d):
    rows = t.load(spark, d, "lineitem").select(F.col("l_linenumber").alias("file"), F.col("l_orderkey").alias("contig"), F.col("l_partkey").alias("hit"))
    return selection.last_wins(rows, "contig", "file").groupBy("contig", "file").agg(F.count(F.lit(1)).alias("hits"))


# --- vectors and random choices


@query(f"WITH {t.VECTORS} SELECT a.id, round(sqrt(list_sum(list_transform(a.vec, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(range(1, 65), lambda i: (a.vec[i] + i) * (b.vec[i] + 1))) / sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.vec[i] + i) * (a.vec[i] + i))) * list_sum(list_transform(b.vec, lambda x: (x + 1) * (x + 1)))), 6) AS cosine, round((a.vec[1] - list_min(a.vec)) / (list_max(a.vec) - list_min(a.vec)), 6) AS first FROM v a JOIN v b ON b.id = a.id + 1")
def vector_scales(spark, d):
    v = t.vectors(spark, d).select("id", "vec")
    both = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    a, b = F.transform("vec", lambda x, i: x + i + 1), F.transform("other", lambda x: x + 1)
    return both.select("id", F.round(fn.norm(F.col("vec")), 6).alias("norm"), F.round(fn.cosine(a, b), 6).alias("cosine"), F.round(fn.min_max(F.col("vec"))[0], 6).alias("first"))


def _u(*key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"


_N = lambda *key: f"(sqrt(-2 * ln({_u(*key, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {_u(*key, chr(39) + 'a' + chr(39))}))"


@query(f"WITH {t.CONTIGS}, s AS (SELECT contig, seq, len, least(len, 49 + floor({_u('contig', chr(39) + 'size' + chr(39))} * (len - 48))::BIGINT) AS size FROM contigs WHERE len >= 50), p AS (SELECT *, floor({_u('contig', chr(39) + 'start' + chr(39))} * (len - size + 1))::BIGINT AS start FROM s) SELECT contig, start::INT AS start, (start + size)::INT AS end_, md5(substr(seq, start + 1, size)) AS digest FROM p")
def random_views(spark, d):
    docs = sequences.contigs(t.load(spark, d, "documents")).where("len >= 50")  # shorter ones have no view
    v = docs.select("contig", fn.view(F.col("seq"), 50, F.col("contig")).alias("v"))
    return v.select("contig", F.col("v.start").alias("start"), F.col("v.end").alias("end_"), F.md5("v.seq").alias("digest"))


_OTHER = lambda key: f"substr(replace('TCGA', b, ''), floor({_u('contig', 'i', key)} * length(replace('TCGA', b, '')))::BIGINT + 1, 1)"
_HIT, _BASE = _u("contig", "i", "'hit'"), "'base'"


@query(f"""WITH {t.CONTIGS}, e AS (SELECT contig, i, substr(seq, i, 1) AS b FROM (SELECT contig, seq, unnest(range(1, len + 1)) AS i FROM contigs WHERE len >= 20)),
m AS (SELECT contig, i, {_HIT} < 0.05 AS hit, b, {_OTHER(_BASE)} AS o FROM e),
x AS (SELECT contig, md5(string_agg(CASE WHEN hit THEN o ELSE b END, '' ORDER BY i)) AS snv, md5(string_agg(CASE WHEN hit THEN b || o ELSE b END, '' ORDER BY i)) AS ins, md5(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT hit), '')) AS del FROM m GROUP BY contig),
y AS (SELECT contig, seq, len, floor(len * 0.05)::BIGINT + 1 AS size, floor({_u('contig', "'at'")} * greatest(len - 2 - floor(len * 0.05)::BIGINT, 1))::BIGINT + 1 AS at_del, floor({_u('contig', "'at'")} * greatest(len - 1, 1))::BIGINT + 1 AS at_ins FROM contigs WHERE len >= 20)
SELECT contig, snv, ins, del, length(seq) + size AS n_block_ins, md5(substr(seq, 1, at_del) || substr(seq, at_del + size + 1)) AS block_del FROM x JOIN y USING (contig)""")
def simulated_sequences(spark, d):
    s, key = F.col("seq"), F.col("contig")
    docs = sequences.contigs(t.load(spark, d, "documents")).where("len >= 20")  # a block needs some bases around it
    return docs.select("contig", F.md5(fn.substituted(s, key, 0.05)).alias("snv"), F.md5(fn.inserted(s, key, 0.05, True)).alias("ins"), F.md5(fn.deleted(s, key, 0.05, True)).alias("del"), F.length(fn.inserted(s, key, 0.05)).cast("long").alias("n_block_ins"), F.md5(fn.deleted(s, key, 0.05)).alias("block_del"))


@query(f"WITH {t.CONTIGS}, p AS (SELECT source, contig, len / sum(len) OVER (PARTITION BY source) * greatest(1, least(16, 0.25 * count(*) OVER (PARTITION BY source))) AS logit FROM contigs WHERE len > 0) SELECT source, contig FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(logit - ln(-ln({_u('contig', chr(39) + '7' + chr(39))})), 9) DESC, contig) = 1")
def weighted_sample(spark, d):
    return sequences.sampled(sequences.contigs(t.load(spark, d, "documents")).where("len > 0"), "source", 7).select("source", "contig")


@query(f"WITH {t.VECTORS}, e AS (SELECT id, i, vec[i + 1] AS x FROM v, (SELECT unnest(range(0, 64)) AS i)) SELECT id, round(sum(CASE WHEN {_u('id', 'i', chr(39) + 'drop' + chr(39))} > 0.1 THEN x ELSE 0 END), 6) AS kept, round(sum(greatest(0, x + 0.01 * {_N('id', 'i')})), 6) AS noisy FROM e GROUP BY id")
def noisy_views(spark, d):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    v = t.vectors(spark, d)
    return v.select("id", total(fn.dropped_out(F.col("vec"), F.col("id"), 0.1)).alias("kept"), total(fn.jittered(F.col("vec"), F.col("id"), 0.01)).alias("noisy"))


@query(f"WITH {t.VECTORS}, r AS (SELECT id, turn FROM v, (SELECT unnest(range(0, 3)) AS turn)) SELECT turn, row_number() OVER (PARTITION BY turn ORDER BY {_u('id', 'turn', chr(39) + '5' + chr(39))}, id) - 1 AS at, id FROM r")
def epoch_order(spark, d):
    rows = t.vectors(spark, d).select("id")
    steps = rows.count() // 10
    return sequences.epoch_order(rows, 10, 2 * steps + steps // 2, 5)


# --- losses of views: four rows are the views of an instance

_VIEWS = f"{t.VECTORS}, w AS (SELECT id, id // 4 AS instance, id % 4 AS view, vec FROM v WHERE id < (SELECT count(*) // 4 * 4 FROM v)), s AS (SELECT a.id, a.view AS va, b.view AS vb, a.instance = b.instance AS same, list_sum(list_transform(range(1, 65), lambda i: a.vec[i] * b.vec[i])) / 0.15::DOUBLE AS s FROM w a, w b WHERE a.id <> b.id)"
_TWO = "p AS (SELECT x.va AS f, x.vb AS l, x.id, x.s FROM s x WHERE same UNION ALL SELECT NULL, NULL, NULL, NULL WHERE false), z AS (SELECT id, va, vb, sum(exp(s)) AS z, sum(exp(2 * s)) AS zb, sum(exp(s)) AS ib, count(*) AS n FROM s WHERE NOT same GROUP BY ALL), pr AS (SELECT least(f, l) AS f, greatest(f, l) AS l, p.id, p.s, a.z + b.z AS z, a.zb + b.zb AS zb, a.ib + b.ib AS ib, a.n + b.n AS n FROM p JOIN z a ON a.id = p.id AND a.vb = p.f JOIN z b ON b.id = p.id AND b.vb = p.l)"


def _views(spark: SparkSession, d: str) -> DataFrame:
    v = t.vectors(spark, d)
    whole = v.agg(F.expr("count(1) div 4 * 4").alias("most"))
    v = v.join(F.broadcast(whole), F.col("id") < F.col("most"))  # one row: instances have all their views
    return losses.view_sums(v.select("id", F.expr("id div 4").alias("instance"), (F.col("id") % 4).cast("int").alias("view"), "vec"), 0.15)


@query(f"WITH {_VIEWS}, n AS (SELECT id, sum(exp(s)) AS z FROM s WHERE NOT same GROUP BY id) SELECT count(*) AS n, round(avg(ln(exp(s) + z) - s), 6) AS loss FROM s JOIN n USING (id) WHERE same")
def infonce_all_views(spark, d):
    return losses.all_views(_views(spark, d)).select("n", F.round("loss", 6).alias("loss"))


@query(f"WITH {_VIEWS}, {_TWO}, c AS (SELECT f, l, avg(ln(exp(s) + z) - s) AS loss FROM pr GROUP BY ALL) SELECT round(sum(loss / (4 - f)) / 4, 6) AS loss FROM c")
def infonce_view_pairs(spark, d):
    return losses.view_pairs(_views(spark, d), 4).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_VIEWS} SELECT round(ln(avg(exp(s))), 6) AS loss FROM s WHERE NOT same")
def infonce_dispersion(spark, d):
    return losses.dispersion(_views(spark, d)).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_VIEWS}, {_TWO}, c AS (SELECT f, l, avg(ln(exp(s) + greatest((zb / (ib / n) - 0.1::DOUBLE * n * exp(s)) / 0.9::DOUBLE, n * exp(-1 / 0.15::DOUBLE))) - s) AS loss FROM pr GROUP BY ALL) SELECT round((sum(loss) + max(loss) FILTER (f = 2)) / 4, 6) AS loss FROM c WHERE l = 3")
def infonce_hard_negatives(spark, d):
    return losses.hard_negatives(_views(spark, d), 4, 0.15, 0.1, 1.0).select(F.round("loss", 6).alias("loss"))


_MIX = f"{t.VECTORS}, o AS (SELECT id // 2 AS id, vec FROM v WHERE id % 2 = 0 AND id + 1 < (SELECT count(*) FROM v)), r AS (SELECT id // 2 AS id, vec FROM v WHERE id % 2 = 1), m AS (SELECT o.id, 0.1::DOUBLE * (o.id % 10) AS share, list_transform(range(1, 65), lambda i: 0.1::DOUBLE * (o.id % 10) * o.vec[i] + (1 - 0.1::DOUBLE * (o.id % 10)) * r.vec[i]) AS vec FROM o JOIN r USING (id))"
_CE = "SELECT m.id, ln(sum(exp(s))) - sum(s) FILTER (m.id = b) AS l FROM (SELECT m.id, x.id AS b, list_sum(list_transform(range(1, 65), lambda i: m.vec[i] * x.vec[i])) / 0.15::DOUBLE AS s FROM m, {} x) m GROUP BY m.id"


@query(f"WITH {_MIX}, a AS ({_CE.format('o')}), b AS ({_CE.format('r')}) SELECT round(avg(a.l * share + b.l * (1 - share)), 6) AS loss FROM m JOIN a USING (id) JOIN b USING (id)")
def infonce_mix_up(spark, d):
    v = t.vectors(spark, d)
    side = lambda k: v.where(F.col("id") % 2 == k).select(F.expr("id div 2").alias("id"), "vec")
    o, r = side(0), side(1)
    share = 0.1 * (F.col("id") % 10)
    mixed = o.join(r.withColumnRenamed("vec", "other"), "id").select("id", F.zip_with("vec", "other", lambda a, b: a * 1.0 + b * 0.0).alias("a"), "vec", "other", share.alias("share"))
    mixed = mixed.select("id", F.zip_with(F.transform("vec", lambda x: F.col("share") * x), F.transform("other", lambda x: (1 - F.col("share")) * x), lambda a, b: a + b).alias("vec"), "share", (1 - F.col("share")).alias("rest"))
    return losses.mixed_up(o, r, mixed, 0.15).select(F.round("loss", 6).alias("loss"))


_SCORES = f"{t.VECTORS}, sc AS (SELECT id // 2 AS id, id % 2 AS view, i AS label, vec[i] AS score FROM v, (SELECT unnest(range(1, 9)) AS i) WHERE id < (SELECT count(*) // 2 * 2 FROM v))"


def _sinkhorn() -> str:
    out = "q0 AS (SELECT view, id, label, exp(score / 0.05::DOUBLE) AS q, count(DISTINCT id) OVER (PARTITION BY view) AS b FROM sc)"
    for i in range(3):
        out += f", r{i} AS (SELECT view, id, label, b, q / sum(q) OVER (PARTITION BY view, label) / 8 AS q FROM q{i}), q{i + 1} AS (SELECT view, id, label, b, q / sum(q) OVER (PARTITION BY view, id) / b AS q FROM r{i})"
    return out


@query(f"WITH {_SCORES}, {_sinkhorn()}, z AS (SELECT view, id, ln(sum(exp(score / 0.1::DOUBLE))) AS z FROM sc GROUP BY ALL), l AS (SELECT q.view, q.id, sum(q.q * q.b * (score / 0.1::DOUBLE - z)) AS l FROM q3 q JOIN sc ON sc.view <> q.view AND sc.id = q.id AND sc.label = q.label JOIN z ON z.view = sc.view AND z.id = sc.id GROUP BY ALL) SELECT round(sum(m) / 2, 6) AS loss FROM (SELECT view, -avg(l) AS m FROM l GROUP BY view)")
def swapped_assignments(spark, d):
    v = t.vectors(spark, d)
    whole = v.agg(F.expr("count(1) div 2 * 2").alias("most"))
    rows = v.join(F.broadcast(whole), F.col("id") < F.col("most"))  # one row
    scores = rows.select((F.col("id") % 2).alias("view"), F.expr("id div 2").alias("id"), F.posexplode(F.slice("vec", 1, 8)).alias("label", "score"))
    return losses.swapped({k: scores.where(F.col("view") == k).drop("view") for k in (0, 1)}, 0.1).select(F.round("loss", 6).alias("loss"))


_PAIRED = f"{t.VECTORS}, p AS (SELECT a.vec AS a, b.vec AS b FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 2 = 0)"


@query(f"WITH {_PAIRED}, e AS (SELECT row_number() OVER () AS r, a, b FROM p), x AS (SELECT r, 'a' AS side, i, a[i] AS x FROM e, (SELECT unnest(range(1, 65)) AS i) UNION ALL SELECT r, 'b', i, b[i] FROM e, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT x.r, x.side, x.i, x.x - avg(x.x) OVER (PARTITION BY x.side, x.i) AS x FROM x), s AS (SELECT side, avg(greatest(0, 1 - sqrt(v + 0.0001::DOUBLE))) / 2 AS l FROM (SELECT side, i, sum(x * x) / (count(*) - 1) AS v FROM c GROUP BY ALL) GROUP BY side), o AS (SELECT side, sum(cv * cv) / 64 AS l FROM (SELECT m.side, m.i, n.i AS j, sum(m.x * n.x) / (count(*) - 1) AS cv FROM c m JOIN c n ON m.side = n.side AND m.r = n.r AND m.i <> n.i GROUP BY ALL) GROUP BY side), d AS (SELECT avg((a[i] - b[i]) * (a[i] - b[i])) AS l FROM e, (SELECT unnest(range(1, 65)) AS i)) SELECT round(25 * (SELECT l FROM d) + 25 * (SELECT sum(l) FROM s) + (SELECT sum(l) FROM o), 6) AS loss")
def variance_covariance(spark, d):
    v = t.vectors(spark, d).select("id", "vec")
    pairs = v.where("id % 2 = 0").join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b")), "id").select("id", F.col("vec").alias("a"), "b")
    return losses.variance_covariance(pairs, 64).select(F.round("loss", 6).alias("loss"))


# --- clustering


@query()
def knn_by_index(spark, d):
    """Neighbours by the index; recall against ``knn_l2`` is measured in the tests."""
    return vectors.knn_index(t.vectors(spark, d).drop("label"), 5).select("src", "dst", F.round("d2", 6).alias("d2"))


def _small(spark: SparkSession, d: str) -> DataFrame:
    """Eight dimensions of the embeddings at length one."""
    return t.vectors(spark, d).select("id", fn.normalised(F.slice("vec", 1, 8)).alias("vec"), "label")


_DENSITY = "CASE WHEN k <= 300 THEN ln(list_sum(list_transform(range(0, 400), lambda j: exp((2 * j + 3) * ln(k / 2) - lgamma(j + 1.0) - lgamma(j + 4.0))))) END"


@query(f"WITH {t.VECTORS}, e AS (SELECT id, list_slice(vec, 1, 8) AS x, (1 + id % 50)::DOUBLE AS k FROM v), n AS (SELECT id, k, x[1] / sqrt(list_sum(list_transform(x, lambda y: y * y))) AS c FROM e) SELECT id, round(k * c - 4 * ln(2 * pi()) - {_DENSITY} + 3 * ln(k), 6) AS f FROM n")
def vmf_density_small(spark, d):
    """Exact log densities in eight dimensions, around the first axis."""
    from ..operators import mixture

    @F.pandas_udf("double")
    def normaliser(k):
        import pandas as pd

        return pd.Series(mixture.log_normaliser(k.to_numpy(), 8))

    kappa = (1 + F.col("id") % 50).cast("double")
    return _small(spark, d).select("id", F.round(kappa * F.col("vec")[0] - normaliser(kappa), 6).alias("f"))


@query()
def vmf_mixture(spark, d):
    """Soft mixture from the labels' means as first centres."""
    import numpy as np

    from ..operators import mixture

    v = t.vectors(spark, d)
    first = np.array([r["mean"] for r in vectors.centroids(v, "label").orderBy("label").collect()])  # one row a label
    model, _ = mixture.fit(v, first, tol=1e-3)
    return mixture.predict(v, model).select("id", "label", F.round("p", 6).alias("p"), F.round("inertia", 6).alias("inertia"))


def _clusters(spark: SparkSession, d: str):
    """Vectors in clusters by label, with marker genes of some of them."""
    v = t.vectors(spark, d)
    members = v.select(F.col("label").cast("string").alias("cluster"), F.col("id").alias("contig"), (1000 + F.col("id") * 37 % 9973).alias("len"))
    genes = v.where("id % 3 = 0").select(F.col("id").alias("contig"), F.concat(F.lit("g"), (F.col("id") % 10 + F.col("label") % 2).cast("string")).alias("gene"), F.lit(1).cast("long").alias("n"))
    sets = spark.createDataFrame([(i // 3, f"g{i}") for i in range(12)], "set_id int, gene string")
    return members, v.select(F.col("id").alias("contig"), "vec"), genes, sets, sets.where("set_id < 2")


@query()
def refined_bins(spark, d):
    from ..operators import refine

    members, vecs, genes, bacteria, archaea = _clusters(spark, d)
    found, quality = refine.refine(members, vecs, genes, bacteria, archaea)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("contigs"), F.sum("len").alias("bp"))
    return quality.join(sizes, "cluster").select("cluster", "level", "domain", F.round("comp", 6).alias("comp"), F.round("cont", 6).alias("cont"), "contigs", "bp")


@query()
def grid_runs(spark, d):
    """Communities of every set of parameters, with how many communities and the sizes of the largest."""
    from ..operators import refine

    v = t.vectors(spark, d)
    near = vectors.knn(v.drop("label"), 100)
    nodes = v.select("id", (1 + F.col("id") % 7).alias("size"), (F.col("id") < 10).alias("fixed"))
    found = refine.grid(near, nodes)
    sizes = found.groupBy("run", "community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("run").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.sum("n").alias("contigs"))


# --- the model's data


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Eleven tokens of a contig, each the shares of 136 words in a segment, and its own words as coverage."""
    docs = sequences.contigs(t.load(spark, d, "documents")).where("len >= 100")
    words = sequences.vocabulary(spark, 4).groupBy("canon").agg(F.min("idx").alias("idx"))  # 136 rows
    shares = sequences.composition(sequences.segments(docs, 11, 4), 4, "contig", "segment").join(F.broadcast(words.withColumnRenamed("canon", "kmer")), "kmer")
    of = shares.groupBy("contig", "segment").agg(F.map_from_entries(F.collect_list(F.struct("idx", "share"))).alias("m"))
    row = F.transform(F.sequence(F.lit(0), F.lit(135)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    tokens = of.groupBy("contig").agg(F.map_from_entries(F.collect_list(F.struct("segment", row.alias("row")))).alias("rows"))
    none = F.array_repeat(F.lit(0.0), 136)
    both = tokens.select(F.col("contig").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.coalesce(F.try_element_at("rows", i), none)).alias("tokens"))
    return both.select("id", "tokens", F.array((F.col("id") % 7 / 7).cast("double")).alias("deviations"), F.col("tokens")[0].alias("coverage"))


@query()
def encoded_contigs(spark, d):
    """Vectors of an untrained model, drawn by a fixed seed."""
    from ..operators import encoder

    model = encoder.drawn_model(136, 11, 1, 136, 16, 1, 8, 1, small=(16, 16), multiple=16)
    return encoder.embed(_tokens(spark, d), model).select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("WITH l AS (SELECT l_suppkey AS run, l_linenumber AS epoch, min(l_tax) AS loss FROM lineitem GROUP BY ALL) SELECT run, epoch, loss FROM l WHERE epoch > 3 QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1")
def best_epoch(spark, d):
    from ..operators import encoder

    rows = t.load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.min("l_tax").alias("loss"))
    return encoder.best_epoch(rows.withColumn("epochs", F.lit(7)))


_VIEW = lambda i: f"concat_ws('/', contig::VARCHAR, '{i}')"


@query(f"WITH {t.CONTIGS}, b AS (SELECT contig, seq, len FROM contigs WHERE len >= 50), p AS (SELECT contig, seq, len, v, CASE v WHEN 1 THEN {_VIEW(1)} ELSE {_VIEW(2)} END AS k FROM b, (SELECT unnest([1, 2]) AS v)), s AS (SELECT *, least(len, 49 + floor({_u('k', chr(39) + 'size' + chr(39))} * (len - 48))::BIGINT) AS size FROM p), q AS (SELECT *, floor({_u('k', chr(39) + 'start' + chr(39))} * (len - size + 1))::BIGINT AS start FROM s) SELECT contig, v AS view, 'part' AS kind, md5(substr(seq, start + 1, size)) AS digest FROM q UNION ALL SELECT contig, v, CASE v WHEN 3 THEN 'masked' ELSE 'whole' END, md5(seq) FROM b, (SELECT unnest([0, 3, 4]) AS v)")
def dense_views(spark, d):
    docs = sequences.contigs(t.load(spark, d, "documents")).where("len >= 50")  # shorter ones have no parts
    return sequences.dense_views(docs, 3, 50).select("contig", "view", "kind", F.md5("seq").alias("digest"))
