"""Registered queries of the analytics operators, each with an independent SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import clustering, evaluation, intervals, markers, selection, sequences, vectors
from ..steps import written
from . import tables as t
from .base import oracle_sql, queries, query

RECALLS, PRECISIONS = [0.01, 0.02, 0.03, 0.04, 0.05], [0.01, 0.02, 0.03, 0.04, 0.05]


# --- evaluation against known genomes


def _counts(spark, d):
    return evaluation.scores(evaluation.overlap(t.aligned(spark, d)))


@query(f"WITH {t.ALIGNED} SELECT bin, genome, tp, round(recall, 9) AS recall, round(prec, 9) AS prec, round(f1, 9) AS f1 FROM cnt QUALIFY row_number() OVER (PARTITION BY bin ORDER BY round(f1, 12) DESC, genome) = 1")
def f1_best_bin(spark, d):
    best = evaluation.best_by(_counts(spark, d).withColumn("key", F.round("f1", 12)), "bin", "key", "genome")
    return best.select("bin", "genome", "tp", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("prec"), F.round("f1", 9).alias("f1"))


@query(f"WITH {t.ALIGNED} SELECT bin, genome, tp, bin_bp - tp AS fp, genome_bp - tp AS fn, (SELECT sum(genome_bp) FROM gbx)::BIGINT - bin_bp - genome_bp + tp AS tn FROM cnt")
def confusion_matrix(spark, d):
    return evaluation.confusion(evaluation.overlap(t.aligned(spark, d))).select("bin", "genome", "tp", "fp", "fn", "tn")


@query(f"WITH {t.ALIGNED} SELECT bin, genome, (SELECT sum(genome_bp) FROM gbx)::BIGINT - bin_bp - genome_bp + 3 * tp AS tn FROM cnt")
def confusion_as_observed(spark, d):
    return evaluation.confusion(evaluation.overlap(t.aligned(spark, d)), True).select("bin", "genome", "tn")


@query(f"WITH {t.ALIGNED}, x AS (SELECT genome, bin, tp::DOUBLE AS tp, (bin_bp - tp)::DOUBLE AS fp, (genome_bp - tp)::DOUBLE AS fn, ((SELECT sum(genome_bp) FROM gbx) - bin_bp - genome_bp + tp)::DOUBLE AS tn FROM cnt) SELECT bin, genome, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0 ELSE (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc, round(2*tp/(2*tp+fp+fn), 6) AS f1 FROM x")
def mcc_f1(spark, d):
    c = evaluation.confusion(evaluation.overlap(t.aligned(spark, d)))
    return c.select("bin", "genome", F.round(evaluation.mcc(), 6).alias("mcc"), F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


_GRID = "grid AS (SELECT r.x AS min_recall, p.x AS min_precision FROM (SELECT unnest([0.01, 0.02, 0.03, 0.04, 0.05])::DOUBLE AS x) r, (SELECT unnest([0.01, 0.02, 0.03, 0.04, 0.05])::DOUBLE AS x) p)"


@query(f"WITH {t.ALIGNED}, {_GRID} SELECT min_recall, min_precision, count(DISTINCT genome) AS n FROM grid LEFT JOIN cnt ON recall >= min_recall AND prec >= min_precision GROUP BY ALL")
def threshold_grid(spark, d):
    return evaluation.threshold_grid(_counts(spark, d), RECALLS, PRECISIONS)


@query(f"WITH {t.ALIGNED}, {_GRID} SELECT min_recall, min_precision, count(DISTINCT n_regionkey) AS n FROM grid LEFT JOIN (cnt JOIN nation ON n_nationkey = genome) ON recall >= min_recall AND prec >= min_precision GROUP BY ALL")
def tax_rollup(spark, d):
    rank = t.load(spark, d, "nation").select(F.col("n_nationkey").alias("genome"), F.col("n_regionkey").alias("taxon"))
    return evaluation.threshold_grid(_counts(spark, d).join(rank, "genome"), RECALLS, PRECISIONS, "taxon")


@query(f"WITH {t.ALIGNED}, b AS (SELECT bin, max(f1) AS f1, max(CASE WHEN recall >= .03 AND prec >= .03 THEN 1 ELSE 0 END) AS nb FROM cnt GROUP BY bin) SELECT x.x AS min_f1, count(*) FILTER (f1 >= x.x) AS n_f1, sum(nb)::BIGINT AS n_both FROM b, (SELECT unnest([.02, .03, .04, .05])::DOUBLE AS x) x GROUP BY x.x")
def f1_counters(spark, d):
    best = _counts(spark, d).groupBy("bin").agg(F.max("f1").alias("f1"), F.max(F.when((F.col("recall") >= 0.03) & (F.col("precision") >= 0.03), 1).otherwise(0)).alias("both"))
    lists = F.explode(F.array(*[F.lit(x) for x in (0.02, 0.03, 0.04, 0.05)]))
    return best.withColumn("min_f1", lists).groupBy("min_f1").agg(F.count_if(F.col("f1") >= F.col("min_f1")).alias("n_f1"), F.sum("both").alias("n_both"))


@query(f"WITH {t.ALIGNED} SELECT genome, arg_max(bin, (round(f1, 12), -bin)) AS bin, round(max(f1), 9) AS f1 FROM cnt GROUP BY genome")
def best_bin_per_genome(spark, d):
    best = evaluation.best_by(_counts(spark, d).withColumn("key", F.round("f1", 12)), "genome", "key", "bin")
    return best.select("genome", "bin", F.round("f1", 9).alias("f1"))


@query("WITH d AS (SELECT o_custkey AS bin, count(*) AS n, sum(o_totalprice) AS bp FROM orders GROUP BY 1) SELECT bin, n, round(bp, 2) AS bp FROM d WHERE n >= 3 AND bp >= 500000")
def bin_size_filter(spark, d):
    o = t.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("bp"))
    return o.where("n >= 3 and bp >= 500000").select("bin", "n", F.round("bp", 2).alias("bp"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) SELECT l_orderkey AS contig, l_partkey AS subject, l_linenumber AS line FROM r WHERE k = 1 OR l_quantity / 50 >= 0.8")
def alignment_admission(spark, d):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = t.load(spark, d, "lineitem").withColumn("k", rank).where("k = 1 or l_quantity / 50 >= 0.8")
    return rows.select(F.col("l_orderkey").alias("contig"), F.col("l_partkey").alias("subject"), F.col("l_linenumber").alias("line"))


# --- intervals and depth


@query(f"WITH {t.READS} SELECT subject, count(*) AS covered FROM depth GROUP BY ALL")
def interval_breadth(spark, d):
    return intervals.breadth(t.reads(spark, d), ["subject"])


@query(f"WITH {t.READS} SELECT subject, round(count(*) / length, 9) AS density, count(*) / length > 0.5 AS dense FROM depth JOIN span USING (subject) GROUP BY subject, length")
def coding_density(spark, d):
    r = t.reads(spark, d)
    span = r.groupBy("subject").agg(F.max("en").alias("length"))
    share = F.col("covered") / F.col("length")
    return intervals.breadth(r, ["subject"]).join(span, "subject").select("subject", F.round(share, 9).alias("density"), (share > 0.5).alias("dense"))


def _depth_hist(spark, d):
    r = t.reads(spark, d)
    runs = intervals.depth_runs(r, ["subject"])
    return intervals.depth_histogram(runs, r.groupBy("subject").agg(F.max("en").alias("length")), ["subject"])


@query(f"WITH {t.READS} SELECT subject, d AS depth, count(*) AS n FROM full_depth GROUP BY ALL")
def depth_profile(spark, d):
    return _depth_hist(spark, d)


@query(f"WITH {t.READS}, c AS (SELECT subject, floor(quantile_cont(d, 0.975))::BIGINT AS cap FROM full_depth GROUP BY ALL) SELECT subject, cap, round(avg(least(d, cap)), 6) AS mean, round(stddev_pop(least(d, cap)), 6) AS std FROM full_depth JOIN c USING (subject) GROUP BY ALL")
def depth_stats(spark, d):
    return intervals.winsorised(_depth_hist(spark, d), ["subject"]).select("subject", "cap", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# --- sequences


def _contigs(spark, d):
    return sequences.contigs(t.load(spark, d, "documents"))


_N50 = "SELECT {0} max(len) AS n50 FROM (SELECT {0} len, sum(len) OVER ({1} ORDER BY len DESC, contig ROWS UNBOUNDED PRECEDING) AS cum, sum(len) OVER ({1}) AS tot FROM contigs WHERE len > 0) WHERE 2 * cum >= tot {2}"


@query(f"WITH {t.CONTIGS} " + _N50.format("", "", ""))
def n50_global(spark, d):
    return sequences.n50(_contigs(spark, d).select("len"))


@query(f"WITH {t.CONTIGS} " + _N50.format("source,", "PARTITION BY source", "GROUP BY source"))
def n50_per_source(spark, d):
    return sequences.n50(_contigs(spark, d).select("source", "len"), "source")


@query(f"WITH {t.CONTIGS}, s AS (SELECT len, row_number() OVER (ORDER BY len DESC, contig) AS r FROM contigs WHERE len < 1000), k AS (SELECT floor(count(*) FILTER (len >= 1000) * 2.0)::BIGINT AS k FROM contigs) SELECT greatest(100, coalesce(max((len - 1) // 10 * 10), 100))::BIGINT AS min_length FROM s, k WHERE r = k + 1")
def min_length_auto(spark, d):
    return sequences.min_length(_contigs(spark, d), 2.0, floor=100)


@query(f"WITH {t.CONTIGS}, s AS (SELECT len, row_number() OVER (ORDER BY len DESC, contig) AS r FROM contigs), n AS (SELECT count(*) AS n, count(*) FILTER (len >= 768) AS c FROM contigs), k AS (SELECT least(n - 1, CASE WHEN c <= 64 THEN 64 ELSE (c // 64 + least(3, (n - c) // 64)) * 64 END) AS k FROM n) SELECT (768 - len)::BIGINT AS gap FROM s, k WHERE r = k + 1")
def lower_bound(spark, d):
    return sequences.lower_bound(_contigs(spark, d), 768, 64)


@query("SELECT n50, n, round((CASE WHEN n50 >= 15000 THEN CASE WHEN n >= 500 THEN .115 ELSE .125 END WHEN n50 <= 5000 THEN CASE WHEN n >= 500 THEN .135 ELSE .145 END ELSE round(-0.000002 * n50 + .155, 3) - CASE WHEN n >= 500 THEN .01 ELSE 0 END END)::DOUBLE, 6) AS temp FROM (SELECT c_custkey * 97 % 20000 AS n50, c_custkey % 1000 AS n FROM customer)")
def temperature_rule(spark, d):
    c = t.load(spark, d, "customer").select((F.col("c_custkey") * 97 % 20000).alias("n50"), (F.col("c_custkey") % 1000).alias("n"))
    return c.withColumn("temp", F.round(fn.temperature(F.col("n50"), F.col("n"), 500), 6))


@query(f"WITH {t.KMERS} SELECT kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ck GROUP BY kmer")
def kmer_global(spark, d):
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # 136 rows are left
    return sequences.kmer_counts(_contigs(spark, d), 4).withColumn("share", F.round(F.col("n") / total, 9))


@query(f"WITH {t.KMERS} SELECT k AS kmer, count(*) AS n FROM ck GROUP BY k")
def kmer_whole(spark, d):
    return sequences.kmer_counts(_contigs(spark, d), 4, canon=False)


@query(f"WITH {t.KMERS} SELECT source, kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM ck GROUP BY source, kmer")
def kmer_composition(spark, d):
    return sequences.composition(_contigs(spark, d), 4, "source").withColumn("share", F.round("share", 9))


@query(f"WITH {t.CONTIGS}, g AS (SELECT contig, seq, len, greatest(1, len // 11) AS gap, unnest(range(0, 11)) AS segment FROM contigs WHERE len >= 100), s AS (SELECT contig, segment, substr(seq, segment * gap + 1, gap) AS seq FROM g), k AS (SELECT contig, segment, substr(seq, i, 4) AS k FROM (SELECT *, unnest(range(1, length(seq) - 2)) AS i FROM s)), c AS (SELECT contig, segment, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM k GROUP BY ALL) SELECT contig, segment::INTEGER AS segment, kmer, n, round(n / sum(n) OVER (PARTITION BY contig, segment), 9) AS share FROM c")
def segment_composition(spark, d):
    cut = sequences.segments(_contigs(spark, d).where("len >= 100"), 11, 4)
    return sequences.composition(cut, 4, "contig", "segment").withColumn("share", F.round("share", 9))


@query("WITH b AS (SELECT unnest(['A','T','G','C']) AS x), w AS (SELECT a.x || b.x || c.x || d.x AS kmer FROM b a, b b, b c, b d), m AS (SELECT kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canon, least(translate(kmer, 'ATGC', '0123'), translate(reverse(translate(kmer, 'ACGT', 'TGCA')), 'ATGC', '0123')) AS f FROM w) SELECT kmer, canon, (dense_rank() OVER (ORDER BY f) - 1)::INTEGER AS idx FROM m")
def kmer_vocab(spark, d):
    return sequences.vocabulary(spark, 4)


# --- markers and quality


@query(f"WITH {t.HITS} SELECT acc, count(*) AS n, count(*) FILTER (CASE WHEN cov < 0.3 THEN false WHEN p_size % 3 = 0 THEN dom >= 30000 ELSE evalue <= 1e-10 AND cov >= 0.7 END) AS kept FROM h GROUP BY acc")
def hit_vetting(spark, d):
    h = t.hits(spark, d)
    none = F.lit(None).cast("struct<full:double,dom:double>")
    ga = F.when(F.col("p_size") % 3 == 0, F.struct(F.lit(30000.0).alias("full"), F.lit(30000.0).alias("dom"))).otherwise(none)
    ok = markers.vetted(F.col("cov"), F.col("evalue"), F.col("dom"), F.col("dom"), F.col("acc"), ga, none, none)
    return h.groupBy("acc").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"))


@query(f"WITH {t.HITS} SELECT acc, scaffold, orf, dom FROM h QUALIFY row_number() OVER (PARTITION BY acc, scaffold, orf ORDER BY dom DESC, l_partkey, l_suppkey) = 1")
def best_hit_per_orf(spark, d):
    return markers.best_hit(t.hits(spark, d), ["acc", "scaffold", "orf"], "dom", ["l_partkey", "l_suppkey"]).select("acc", "scaffold", "orf", "dom")


@query("WITH o AS (SELECT DISTINCT l_orderkey AS scaffold, l_linenumber AS orf FROM lineitem), i AS (SELECT scaffold, orf - row_number() OVER (PARTITION BY scaffold ORDER BY orf) AS g FROM o), r AS (SELECT scaffold, g, (count(*) + 1) // 2 AS n FROM i GROUP BY ALL) SELECT scaffold, 1 AS gene, sum(n)::BIGINT AS n FROM r GROUP BY scaffold")
def adjacent_merge(spark, d):
    o = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("scaffold"), F.lit(1).alias("gene"), F.col("l_linenumber").alias("orf"))
    return markers.merged_neighbours(o, "scaffold", "gene", "orf")


@query(f"WITH {t.MARKERS} SELECT * FROM mk")
def marker_incidence(spark, d):
    return t.marker_counts(spark, d)


@query(f"WITH {t.MARKERS} SELECT gene, count(*) AS n FROM mk GROUP BY gene ORDER BY n DESC, gene LIMIT 1")
def marker_most_contigs(spark, d):
    return t.marker_counts(spark, d).groupBy("gene").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gene").limit(1)


_SETS = "st AS (SELECT DISTINCT p_brand AS gene, ascii(substr(p_brand, length(p_brand), 1)) % 4 AS set_id FROM part), sz AS (SELECT set_id, count(*) AS size FROM st GROUP BY ALL), per AS (SELECT b.bin, st.set_id, sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END) / any_value(size) AS p, sum(greatest(coalesce(n, 0) - 1, 0)) / any_value(size) AS x FROM (SELECT DISTINCT bin FROM mk) b CROSS JOIN st JOIN sz USING (set_id) LEFT JOIN mk ON mk.bin = b.bin AND mk.gene = st.gene GROUP BY ALL)"


def _sets(spark, d):
    return t.load(spark, d, "part").select(F.col("p_brand").alias("gene"), (F.ascii(F.expr("substr(p_brand, length(p_brand), 1)")) % 4).alias("set_id")).distinct()


@query(f"WITH {t.MARKERS}, {_SETS} SELECT bin, round(100 * avg(p), 6) AS comp, round(100 * avg(x), 6) AS cont FROM per GROUP BY bin")
def genome_check(spark, d):
    return markers.genome_check(t.marker_counts(spark, d), _sets(spark, d)).select("bin", F.round("comp", 6).alias("comp"), F.round("cont", 6).alias("cont"))


@query(f"WITH {t.MARKERS}, {_SETS}, s2 AS (SELECT bin, count(*) * 100.0 / (SELECT count(*) FROM st) AS comp, sum(n - 1) * 100.0 / (SELECT count(*) FROM st) AS cont FROM mk GROUP BY bin), s1 AS (SELECT bin, 100 * avg(p) AS comp, 100 * avg(x) AS cont FROM per GROUP BY bin) SELECT bin, CASE WHEN round(s1.comp + s1.cont, 9) > round(s2.comp + s2.cont, 9) THEN 'bacteria' ELSE 'archaea' END AS domain, round(CASE WHEN round(s1.comp + s1.cont, 9) > round(s2.comp + s2.cont, 9) THEN s1.comp ELSE s2.comp END, 6) AS comp FROM s1 JOIN s2 USING (bin)")
def domain_choice(spark, d):
    counts, sets = t.marker_counts(spark, d), _sets(spark, d)
    chosen = markers.domain_choice(markers.genome_check(counts, sets), markers.genome_check(counts, sets.withColumn("set_id", F.lit(0))))
    return chosen.select("bin", "domain", F.round("comp", 6).alias("comp"))


@query(f"WITH {t.QUALITY} SELECT bin, CASE WHEN comp >= 90 AND cont <= 5 THEN 'high' WHEN comp >= 50 AND cont <= 10 THEN 'medium' ELSE 'low' END AS state FROM q")
def quality_state(spark, d):
    return t.quality(spark, d).select("bin", fn.quality_state(F.col("comp"), F.col("cont")).alias("state"))


@query(f"WITH {t.QUALITY} SELECT bin, round(comp - 4 * cont + CASE WHEN comp >= 90 AND cont <= 5 THEN 100 WHEN comp >= 50 AND cont <= 10 THEN 50 ELSE 0 END, 6) AS score, round(comp - 4 * cont, 6) AS plain FROM q")
def quality_score(spark, d):
    c, n = F.col("comp"), F.col("cont")
    return t.quality(spark, d).select("bin", F.round(fn.quality_score(c, n), 6).alias("score"), F.round(fn.quality_score(c, n, False), 6).alias("plain"))


@query(f"WITH {t.QUALITY} SELECT method, round(sum(CASE WHEN comp >= 90 AND cont <= 5 THEN comp - 4 * cont + 120 WHEN comp >= 50 AND cont <= 10 THEN comp - 4 * cont + 50 ELSE 0 END), 4) AS score FROM q GROUP BY method")
def grid_score(spark, d):
    return t.quality(spark, d).groupBy("method").agg(F.round(F.sum(fn.grid_score(F.col("comp"), F.col("cont"))), 4).alias("score"))


_STATS = f"""{t.QUALITY}, c AS (SELECT method, count(*) FILTER (comp > 50 AND cont < 10) AS n5010, count(*) FILTER (comp > 70 AND cont < 10) AS n7010, count(*) FILTER (comp > 90 AND cont < 10) AS n9010,
 count(*) FILTER (comp > 50 AND cont < 5) AS n505, count(*) FILTER (comp > 70 AND cont < 5) AS n705, count(*) FILTER (comp >= 90 AND cont <= 5) AS n905 FROM q GROUP BY method), s AS (SELECT *, n5010 + n7010 + n9010 + n505 + n705 + n905 AS total FROM c)"""


@query(f"WITH {_STATS} SELECT * FROM s")
def method_stats(spark, d):
    return selection.method_stats(t.quality(spark, d))


@query(f"WITH {_STATS}, g AS (SELECT *, CASE WHEN method < 'm3' THEN 'a' ELSE 'b' END AS grp FROM s), b AS (SELECT grp, arg_max(method, (n905, -ascii(substr(method, 2)))) AS m FROM g GROUP BY grp UNION SELECT grp, arg_max(method, (total, -ascii(substr(method, 2)))) FROM g GROUP BY grp) SELECT grp, m AS method FROM b")
def best_method(spark, d):
    stats = selection.method_stats(t.quality(spark, d)).withColumn("grp", F.when(F.col("method") < "m3", "a").otherwise("b"))
    return selection.best_methods(stats, "grp")


@query(f"WITH {t.QUALITY}, z AS (SELECT rep, bin AS member, round(comp - 4 * cont + CASE WHEN comp >= 90 AND cont <= 5 THEN 100 WHEN comp >= 50 AND cont <= 10 THEN 50 ELSE 0 END, 6) AS score FROM q) SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY rep ORDER BY score DESC, member) = 1")
def derep_best(spark, d):
    return selection.dereplicate(t.quality(spark, d).withColumnRenamed("bin", "member"))


@query(f"WITH {t.QUALITY} SELECT bin FROM q WHERE NOT (abs(comp - scg_comp) > 40 AND scg_comp < 10)")
def gap_filter(spark, d):
    return selection.without_gaps(t.quality(spark, d)).select("bin")


@query("WITH r AS (SELECT o_custkey AS cluster, o_orderkey AS contig, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey)::BIGINT AS total FROM orders) SELECT cluster, contig, rn // (n // (CASE WHEN total >= 2000000 THEN total // 2000000 + 2 ELSE 1 END) + 1) AS part FROM r")
def size_capped_split(spark, d):
    o = t.load(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("contig"), F.round("o_totalprice").cast("long").alias("len"))
    return selection.capped_parts(o, 2000000)


# --- vectors


@query(f"WITH {t.NEAR} SELECT src, dst, round(d2, 6) AS d2 FROM nn")
def knn_l2(spark, d):
    return vectors.knn(t.vectors(spark, d).drop("label"), 5).select("src", "dst", F.round("d2", 6).alias("d2"))


@query(f"WITH {t.NEAR}, c AS (SELECT quantile_cont(d2, 0.75) AS cut FROM nn) SELECT src, dst, round(exp(-d2 / 0.5), 6) AS weight FROM nn, c WHERE round(d2, 9) <= round(cut, 9) AND src > dst")
def edge_build(spark, d):
    near = vectors.knn(t.vectors(spark, d).drop("label"), 5).withColumn("d2", F.round("d2", 9))
    return vectors.build_edges(near, 0.75, 0.5).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {t.PAIRS} SELECT round(ln(avg(exp(-2 * d2))), 6) AS uniformity, round(avg(d2) FILTER (la = lb), 6) AS alignment FROM pr WHERE src < dst")
def uniformity_alignment(spark, d):
    s = vectors.pair_sums(t.vectors(spark, d))
    return s.select(F.round(F.ln(F.col("potential") / F.col("n")), 6).alias("uniformity"), F.round(F.col("d2_same") / F.col("n_same"), 6).alias("alignment"))


@query(f"WITH {t.VECTORS}, c AS (SELECT label, i, avg(vec[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM v GROUP BY ALL) SELECT label, n, round(sqrt(sum(m * m)), 6) AS norm FROM c JOIN n USING (label) GROUP BY ALL")
def kmeans_step(spark, d):
    c = vectors.centroids(t.vectors(spark, d), "label")
    return c.select("label", "n", F.round(F.sqrt(fn.dot(F.col("mean"), F.col("mean"))), 6).alias("norm"))


@query(f"WITH {t.VECTORS}, c AS (SELECT label, i, avg(vec[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) SELECT label, round(sum((vec[i] - m) * (vec[i] - m)), 6) AS inertia FROM v JOIN c USING (label) GROUP BY label")
def kmeans_inertia(spark, d):
    v = t.vectors(spark, d)
    far = v.join(F.broadcast(vectors.centroids(v, "label")), "label")  # one row a label
    return far.groupBy("label").agg(F.round(F.sum(fn.squared_distance(F.col("vec"), F.col("mean"))), 6).alias("inertia"))


@query(f"WITH {t.VECTORS}, c AS (SELECT label, i, sum(vec[i]) AS s FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), r AS (SELECT label, sqrt(sum(s * s)) AS r FROM c GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT label, n, r / n AS rb FROM r JOIN n USING (label)) SELECT label, round(n / (SELECT count(*) FROM v), 6) AS weight, round((rb * 64 - rb * rb * rb) / (1 - rb * rb), 6) AS kappa FROM b")
def vmf_m_step(spark, d):
    v = t.vectors(spark, d)
    c = vectors.centroids(v, "label").withColumn("rb", F.sqrt(fn.dot(F.col("mean"), F.col("mean"))))
    total = v.agg(F.count(F.lit(1)).alias("all"))
    kappa = F.when(F.abs(F.col("rb") - 1) < 1e-10, F.lit(1e10)).otherwise((F.col("rb") * 64 - F.pow("rb", F.lit(3))) / (1 - F.col("rb") * F.col("rb")))
    return c.join(F.broadcast(total)).select("label", F.round(F.col("n") / F.col("all"), 6).alias("weight"), F.round(kappa, 6).alias("kappa"))  # one row


# --- sets and reports


_GENOMES = "a AS (SELECT DISTINCT s_nationkey AS genome FROM supplier WHERE s_acctbal > 5000), b AS (SELECT DISTINCT c_nationkey AS genome FROM customer WHERE c_acctbal > {})"


def _genomes(spark, d, least):
    a = t.load(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("genome")).distinct()
    return a, t.load(spark, d, "customer").where(F.col("c_acctbal") > least).select(F.col("c_nationkey").alias("genome")).distinct()


@query(f"WITH {_GENOMES.format(9990)} SELECT genome FROM a EXCEPT SELECT genome FROM b")
def set_diff_genomes(spark, d):
    a, b = _genomes(spark, d, 9990)
    return a.join(b, "genome", "left_anti")


@query(f"WITH {_GENOMES.format(9000)} SELECT genome FROM a INTERSECT SELECT genome FROM b")
def set_intersect(spark, d):
    a, b = _genomes(spark, d, 9000)
    return a.intersect(b)


@query("WITH m AS (SELECT l_returnflag AS tool, s_nationkey AS genome, max(l_quantity) AS cov FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) SELECT tool, round(sum(cov) / (SELECT count(DISTINCT genome) FROM m), 6) AS mean_cov FROM m GROUP BY tool")
def genome_cov_union(spark, d):
    s = t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genome"))
    m = t.load(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity").join(s, "l_suppkey").groupBy(F.col("l_returnflag").alias("tool"), "genome").agg(F.max("l_quantity").alias("cov"))
    all_ = m.agg(F.countDistinct("genome").alias("genomes"))
    return m.groupBy("tool").agg(F.sum("cov").alias("cov")).join(F.broadcast(all_)).select("tool", F.round(F.col("cov") / F.col("genomes"), 6).alias("mean_cov"))  # one row


@query("WITH a AS (SELECT s_nationkey AS genome, sum(l_quantity) AS ab FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), r AS (SELECT genome, row_number() OVER (ORDER BY ab DESC, genome) AS r, count(*) OVER () AS n FROM a) SELECT genome, CASE WHEN r <= n // 2 THEN 'high' ELSE 'low' END AS half FROM r")
def abundance_halves(spark, d):
    s = t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("genome"))
    a = t.load(spark, d, "lineitem").select("l_suppkey", "l_quantity").join(s, "l_suppkey").groupBy("genome").agg(F.sum("l_quantity").alias("ab"))
    one = Window.partitionBy(F.lit(1))  # one row a genome
    r = F.row_number().over(one.orderBy(F.desc("ab"), "genome"))
    return a.withColumn("r", r).withColumn("n", F.count(F.lit(1)).over(one)).select("genome", F.when(F.col("r") <= F.expr("n div 2"), "high").otherwise("low").alias("half"))


@query("WITH g AS (SELECT l_partkey AS genome, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg((a - r) / a), 6) AS gap FROM g WHERE a > 0")
def gene_gap_pivot(spark, d):
    p = t.load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("genome")).pivot("l_returnflag", ["A", "R"]).count().fillna(0)
    return p.where("A > 0").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("A") - F.col("R")) / F.col("A")), 6).alias("gap"))


_FIT = """ge AS (SELECT l_orderkey AS contig, p_type AS gene, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
cg AS (SELECT o_custkey AS cluster, o_orderkey AS contig, round(o_totalprice)::BIGINT AS len, list({'g': gene, 'n': n} ORDER BY gene) AS genes FROM ge JOIN orders ON o_orderkey = contig GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY len DESC, contig) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM cg),
fit AS (SELECT cluster, contig, r, 0::BIGINT AS grp, [genes] AS groups FROM rk WHERE r = 1
  UNION ALL SELECT cluster, contig, r, slot, CASE WHEN slot < len(groups) THEN list_transform(groups, lambda x, i: CASE WHEN i = slot + 1 THEN list_concat(x, genes) ELSE x END) ELSE list_append(groups, genes) END
  FROM (SELECT rk.cluster, rk.contig, rk.r, rk.genes, f.groups, CASE WHEN rk.n <= 3 THEN 0 ELSE coalesce(nullif(list_position(list_transform(f.groups, lambda x: len(list_filter(rk.genes, lambda g: len(list_filter(x, lambda y: y.g = g.g AND y.n + g.n > 1)) > 0)) = 0), true), 0) - 1, len(f.groups)) END::BIGINT AS slot
        FROM fit f JOIN rk ON rk.cluster = f.cluster AND rk.r = f.r + 1))"""


@query(f'WITH RECURSIVE {_FIT} SELECT cluster, contig, grp::INT AS "group" FROM fit')
def first_fit_allocate(spark, d):
    li = t.load(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("gene"))
    order = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cluster"), F.round("o_totalprice").cast("long").alias("len"))
    genes = li.join(part, "l_partkey").groupBy("l_orderkey", "gene").agg(F.count(F.lit(1)).alias("n")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("gene", "n"))).alias("genes"))
    return markers.first_fit(genes.join(order, "l_orderkey").select("cluster", F.col("l_orderkey").alias("contig"), "len", "genes"))


# --- further scores of sequences and vectors


@query(f"WITH {t.KMERS}, {t.READS}, x AS (SELECT contig, kmer, unnest([i - 1, i, i + 1, i + 2]) AS p FROM ck) SELECT contig, kmer, round(sum(d) / (4 * any_value(len)), 9) AS cov FROM x JOIN depth ON subject = contig AND depth.p = x.p JOIN contigs USING (contig) GROUP BY contig, kmer")
def cov_tnf(spark, d):
    runs = intervals.depth_runs(t.reads(spark, d), ["subject"]).withColumnRenamed("subject", "contig")
    return sequences.coverage_composition(_contigs(spark, d), runs, 4).withColumn("cov", F.round("cov", 9))


@query(f"WITH {t.CONTIGS}, r AS (SELECT contig, len, row_number() OVER (ORDER BY len DESC, contig) AS r, count(*) OVER () AS n FROM contigs) SELECT contig, len FROM r WHERE r <= n // 64 * 64")
def topk_batch(spark, d):
    return sequences.top_batches(_contigs(spark, d), 64)


@query(f"WITH {t.CONTIGS} SELECT contig, round(ln(len) / ln(100), 9) AS weight FROM contigs WHERE len >= 100")
def length_weights(spark, d):
    return _contigs(spark, d).where("len >= 100").select("contig", F.round(fn.length_weight(F.col("len"), 100), 9).alias("weight"))


@query("SELECT a.o_orderkey AS contig, (count(*) - 1) // (any_value(n) // 4 + 1) AS chunk FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey <= a.o_orderkey JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) c ON c.o_custkey = a.o_custkey GROUP BY 1")
def equal_chunks(spark, d):
    o = t.load(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("contig"))
    return selection.chunks(o, "cluster", "contig", 4).select("contig", "chunk")


@query("SELECT r_regionkey AS run, (e)::INTEGER AS epoch, CASE WHEN e = 46 THEN round(r_regionkey * 0.01 + 0.115::DOUBLE + 0.005, 9) ELSE round(r_regionkey * 0.01::DOUBLE + 0.115::DOUBLE - 0.005::DOUBLE + e * 0.01::DOUBLE / 47, 3) END AS temp FROM region, (SELECT unnest(range(0, 47)) AS e)")
def schedule_temp(spark, d):
    of = fn.temperature_schedule(F.col("r_regionkey") * 0.01 + 0.115, 47)
    return t.load(spark, d, "region").select(F.col("r_regionkey").alias("run"), F.posexplode(of).alias("epoch", "temp")).withColumn("temp", F.round("temp", 9))


@query("SELECT n_nationkey AS epoch, round(CASE WHEN n_nationkey <= 5 THEN 0.001::DOUBLE * (9 * n_nationkey / 5 + 1) ELSE 0.005::DOUBLE * (1 + cos(pi() * ((n_nationkey - 5) % 10) / 10)) END, 9) AS lr FROM nation")
def schedule_lr(spark, d):
    return t.load(spark, d, "nation").select(F.col("n_nationkey").alias("epoch"), F.round(fn.learning_rate(F.col("n_nationkey"), 0.001, 10, 5, 19), 9).alias("lr"))


@query("SELECT c_custkey, least(200, CASE WHEN n >= 900 THEN b ELSE 900 * b // n END)::BIGINT AS epochs FROM (SELECT c_custkey, c_custkey % 1000 + 50 AS n, CASE WHEN c_custkey * 97 % 20000 >= 1536 THEN 39 ELSE 35 END AS b FROM customer)")
def epoch_rule(spark, d):
    n50, n = F.col("c_custkey") * 97 % 20000, F.col("c_custkey") % 1000 + 50
    return t.load(spark, d, "customer").select("c_custkey", fn.epochs(n50, n, 35, 900).alias("epochs"))


@query(f"WITH {t.NEAR} SELECT src, dst, round(exp(-d2 / 0.5), 6) AS weight, round(exp(-sqrt(d2) / 0.5), 6) AS weight_root FROM nn")
def edge_weight(spark, d):
    near = vectors.knn(t.vectors(spark, d).drop("label"), 5)
    return near.select("src", "dst", F.round(fn.edge_weight(F.col("d2"), 0.5), 6).alias("weight"), F.round(fn.edge_weight(F.col("d2"), 0.5, False), 6).alias("weight_root"))


@query(f"WITH {t.NEAR}, e AS (SELECT src, dst, exp(-d2 / 0.5) AS w FROM nn WHERE src > dst), n AS (SELECT label, sum(1 + id % 7) AS s FROM v GROUP BY ALL), i AS (SELECT a.label, sum(w) AS w FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.label = b.label GROUP BY ALL), p AS (SELECT (SELECT sum(w) FROM e) / ((SELECT sum(s) FROM n) * ((SELECT sum(s) FROM n) - 1) / 2.0) AS p) SELECT label AS community, round(coalesce(w, 0) - 2 * p * s * (s - 1) / 2.0, 6) AS q FROM n LEFT JOIN i USING (label), p")
def rber_quality(spark, d):
    v = t.vectors(spark, d)
    e = vectors.knn(v.drop("label"), 5).where("src > dst").select("src", "dst", fn.edge_weight(F.col("d2"), 0.5).alias("weight"))
    nodes = v.select("id", F.col("label").alias("community"), (1 + F.col("id") % 7).alias("size"))
    return vectors.rber_quality(e, nodes, 2.0).select("community", F.round("q", 6).alias("q"))


@query(f"WITH {t.PAIRS}, m AS (SELECT src, la, lb, avg(sqrt(d2)) AS m FROM pr GROUP BY ALL), s AS (SELECT src, la, max(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM m GROUP BY ALL) SELECT la AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS s FROM s GROUP BY la")
def silhouette(spark, d):
    return vectors.silhouette(t.vectors(spark, d)).groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("s"))


_CENTRES = f"{t.VECTORS}, c AS (SELECT label, i, avg(vec[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), dots AS (SELECT v.id, v.label AS own, c.label, sum(vec[i] * m) AS dot FROM v, c GROUP BY ALL)"


@query(f"WITH {_CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dot, 9) DESC, label) AS r FROM dots) SELECT k::INTEGER AS k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE label = own GROUP BY ALL")
def topk_accuracy(spark, d):
    ranked = vectors.label_ranks(t.vectors(spark, d), "label")
    return ranked.select("r", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5)])).alias("k")).groupBy("k").agg(F.round(F.avg(F.when(F.col("r") <= F.col("k"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


_S = "(sqrt({k} * {k} + {b} * {b}) - {b} - {a} * ln(({a} + sqrt({k} * {k} + {b} * {b})) / ({a} + {b})))"


@query(f"WITH {_CENTRES}, b AS (SELECT label, sqrt(sum(m * m)) AS r FROM c GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM v GROUP BY ALL), k AS (SELECT label, r, n, (r * 64 - r * r * r) / (1 - r * r) AS k FROM b JOIN n USING (label)), l AS (SELECT *, least(k, sqrt((3 * 31 + 5.5) * 32.5)) AS lo FROM k), f AS (SELECT id, label, ln(n::DOUBLE) + k * dot / r - ({_S.format(k='k', a='31.5::DOUBLE', b='31.5::DOUBLE')} + {_S.format(k='lo', a='31.0::DOUBLE', b='33.0::DOUBLE')} - {_S.format(k='lo', a='31.5::DOUBLE', b='31.5::DOUBLE')}) AS f FROM dots JOIN l USING (label)) SELECT id, label, round(exp(f - max(f) OVER (PARTITION BY id)) / sum(exp(f)) OVER (PARTITION BY id) * exp(max(f) OVER (PARTITION BY id)), 6) AS p FROM f")
def vmf_e_step(spark, d):
    v = vectors.with_centres(t.vectors(spark, d), "label")
    r = lambda c: F.sqrt(fn.dot(c["mean"], c["mean"]))
    kappa = lambda c: (r(c) * 64 - F.pow(r(c), F.lit(3))) / (1 - r(c) * r(c))
    logits = F.transform("centres", lambda c: F.ln(c["n"].cast("double")) + fn.vmf_log_density(fn.dot(F.col("vec"), c["mean"]) / r(c), kappa(c), 64))
    parts = v.select("id", F.transform("centres", lambda c: c["label"]).alias("labels"), logits.alias("f")).select("id", F.explode(F.arrays_zip("labels", fn.softmax(F.col("f")).alias("p"))).alias("x"))
    return parts.select("id", F.col("x.labels").alias("label"), F.round("x.p", 6).alias("p"))


@query(f"WITH {t.ALIGNED}, {t.QUALITY}, f AS (SELECT bin, max(f1) AS f1 FROM cnt GROUP BY bin), s AS (SELECT rep AS bin, max(comp) AS comp, count(*) AS n FROM q GROUP BY rep) SELECT n_name AS genome, f.bin, round(f1, 9) AS f1, round(comp, 6) AS comp, n FROM f JOIN s USING (bin) JOIN nation ON n_nationkey = f.bin")
def gather_info(spark, d):
    f1 = _counts(spark, d).groupBy("bin").agg(F.max("f1").alias("f1"))
    q = t.quality(spark, d).groupBy(F.col("rep").alias("bin")).agg(F.max("comp").alias("comp"), F.count(F.lit(1)).alias("n"))
    names = t.load(spark, d, "nation").select(F.col("n_nationkey").alias("bin"), F.col("n_name").alias("genome"))
    return f1.join(q, "bin").join(names, "bin").select("genome", "bin", F.round("f1", 9).alias("f1"), F.round("comp", 6).alias("comp"), "n")


@query("""WITH RECURSIVE h AS (SELECT l_orderkey AS orf, 'PF' || regexp_replace(p_brand, '\\D', '', 'g') || '.1' AS acc, (p_size % 3)::VARCHAR AS clan, l_discount AS full_e, l_tax AS i_e, l_linenumber::BIGINT * 5 AS st, l_linenumber::BIGINT * 5 + l_quantity::BIGINT AS en FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY orf ORDER BY full_e, i_e, acc, st, en, clan) AS k FROM h),
f AS (SELECT orf, k, true AS ok, [{'clan': clan, 'st': st, 'en': en}] AS kept FROM r WHERE k = 1
  UNION ALL SELECT orf, k, ok, CASE WHEN ok THEN list_append(kept, {'clan': clan, 'st': st, 'en': en}) ELSE kept END
  FROM (SELECT r.*, f.kept, len(list_filter(f.kept, lambda x: x.clan = r.clan AND ((x.st <= r.st AND r.st < x.en) OR (r.st <= x.st AND x.st < r.en)))) = 0 AS ok FROM f JOIN r ON r.orf = f.orf AND r.k = f.k + 1))
SELECT r.orf, acc, clan, full_e, i_e, st, en FROM r JOIN f ON f.orf = r.orf AND f.k = r.k WHERE ok""")
def clan_filter(spark, d):
    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("PF"), F.regexp_replace("p_brand", r"\D", ""), F.lit(".1")).alias("acc"), (F.col("p_size") % 3).cast("string").alias("clan"))
    li = t.load(spark, d, "lineitem").join(part, "l_partkey")
    st = F.col("l_linenumber").cast("long") * 5
    return markers.without_clan_rivals(li.select(F.col("l_orderkey").alias("orf"), "acc", "clan", F.col("l_discount").alias("full_e"), F.col("l_tax").alias("i_e"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en")))


# --- clustering


@query(f"WITH {t.VECTORS}, s AS (SELECT a.id, a.id // 2 = b.id // 2 AS same, list_sum(list_transform(range(1, 65), lambda i: a.vec[i] * b.vec[i])) / 0.15::DOUBLE AS s FROM v a, v b WHERE a.id <> b.id), r AS (SELECT id, ln(sum(exp(s))) - sum(s) FILTER (same) AS l FROM s GROUP BY id) SELECT count(*) AS n, round(avg(l), 6) AS loss FROM r")
def infonce(spark, d):
    v = t.vectors(spark, d).drop("label").withColumn("instance", F.expr("id div 2"))
    return clustering.infonce(v, 0.15).select("n", F.round("loss", 6).alias("loss"))


@query()
def kmeans_seeded(spark, d):
    v = t.vectors(spark, d)
    seeds = v.groupBy("label").agg(F.min("id").alias("id"))  # a seed for each copy of a marker
    weighted = v.select("id", "vec", fn.length_weight(1000 + F.col("id") % 977, 768).alias("weight"))
    return clustering.kmeans_seeded(weighted, seeds).withColumn("d2", F.round("d2", 6))


@query()
def community_labels(spark, d):
    v = t.vectors(spark, d)
    edges = vectors.build_edges(written(vectors.knn(v.drop("label"), 5)), 0.75, 0.5)
    first = v.groupBy("label").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("fixed"))
    nodes = v.select("id", (1 + F.col("id") % 7).alias("size")).join(first, "id", "left").fillna(False, ["fixed"])
    return clustering.communities(edges, nodes, 2.0)


@query("SELECT c_custkey AS cluster, CASE WHEN c_custkey * 31 % 12000 <= 10000 THEN 'von' ELSE 'flspp' END AS von, CASE WHEN c_custkey * 31 % 12000 BETWEEN 150 AND 1850 THEN 'von' ELSE 'flspp' END AS mix, greatest(0, least(c_custkey * 31 % 12000 - 1, c_custkey % 9 + 2) - greatest(2, c_custkey % 9 - 2) + 1)::INTEGER AS tries FROM customer")
def split_choice(spark, d):
    n, groups = F.col("c_custkey") * 31 % 12000, F.col("c_custkey") % 9
    return t.load(spark, d, "customer").select(F.col("c_custkey").alias("cluster"), clustering.algorithm(n, "von").alias("von"), clustering.algorithm(n, "mix").alias("mix"), F.size(clustering.split_counts(groups, n)).alias("tries"))


@query(f"WITH {t.QUALITY} SELECT bin, CASE WHEN cont > 10 THEN 'split' WHEN cont > 5 THEN 'allocate' ELSE 'keep' END AS first, CASE WHEN cont > 10 THEN 'split' WHEN cont > 5 THEN 'allocate' ELSE 'keep' END AS again FROM q")
def refine_action(spark, d):
    return t.quality(spark, d).select("bin", clustering.action(F.col("cont")).alias("first"), clustering.action(F.col("cont")).alias("again"))


@query(f"""WITH RECURSIVE {_FIT}, ng AS (SELECT l_orderkey AS contig, count(DISTINCT l_partkey) AS n_genes FROM lineitem GROUP BY 1), m AS (SELECT o_custkey AS cluster, o_orderkey AS contig, round(o_totalprice)::BIGINT AS len FROM orders),
bare AS (SELECT cluster, sum(len) AS bare FROM m WHERE contig NOT IN (SELECT contig FROM fit) GROUP BY 1), p AS (SELECT fit.cluster, grp AS part, sum(len) AS own, sum(n_genes) AS genes FROM fit JOIN m USING (contig) JOIN ng USING (contig) GROUP BY ALL),
x AS (SELECT p.cluster, part::INT AS part, (own + coalesce(bare, 0))::BIGINT AS bp, genes::BIGINT AS genes, sum(genes) OVER (PARTITION BY p.cluster) AS whole FROM p LEFT JOIN bare ON bare.cluster = p.cluster)
SELECT cluster, part, bp, genes, row_number() OVER (PARTITION BY cluster ORDER BY round(genes / greatest(whole, 1) + ln(greatest(bp, 1)) / 20, 12) DESC, part) AS rank FROM x WHERE part = 0 OR bp >= 25000""")
def unlearned_split(spark, d):
    members = t.load(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("contig"), F.round("o_totalprice").cast("long").alias("len"))
    counts = t.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("contig")).agg(F.countDistinct("l_partkey").alias("n_genes"))
    return clustering.unlearned_split(first_fit_allocate(spark, d).join(counts, "contig"), members)


from . import files, more  # noqa: E402, F401 - they register their queries

__all__ = ["oracle_sql", "queries"]
