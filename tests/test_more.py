"""Operators that SQL can't express, against plain Python or by what must hold; rules of sources on hand-made files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom import functions as fn
from binloom import plans, sources, steps
from binloom.operators import depths, encoder, markers, mixture, partition, refine, selection, sequences, vectors

SF = "/root/testdata/sf0.001"


def _blobs(n, k, dim, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((k, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    of = np.arange(n) % k
    x = c[of] + spread * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), of


def _same(a, b):
    """Equal up to names."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_log_bessel():
    for nu in (0.0, 1.5, 3.0, 24.0):
        for x in (0.01, 1.0, 20.0, 250.0, 301.0, 2000.0):
            t = np.linspace(0, math.pi, 200_001)
            # Poisson's integral, scaled by exp(-x)
            f = np.exp(x * np.cos(t) - x) * np.sin(t) ** (2 * nu)
            want = x + nu * math.log(x / 2) - 0.5 * math.log(math.pi) - math.lgamma(nu + 0.5) + math.log(np.trapezoid(f, t))
            assert abs(float(mixture.log_bessel(nu, np.array([x]))[0]) - want) < 1e-5 * max(1, abs(want)), (nu, x)


@pytest.mark.parametrize("dim", [8, 64])
@pytest.mark.parametrize("init", ["k-means++", "random", "random-orthonormal", "random-class"])
def test_mixture_starts(dim, init):
    x, of = _blobs(300, 3, dim)
    best = max((mixture.fit_rows(x, 3, init, seed=s) for s in range(5)), key=lambda f: -f[2])
    assert _same(best[1], of)
    assert abs(best[0].weights.sum() - 1) < 1e-9 and np.allclose(np.linalg.norm(best[0].centres, axis=1), 1)


def test_mixture_of_a_table(spark):
    x, of = _blobs(400, 4, 64)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)
    for hard in (False, True):
        model, like = mixture.fit(v, x[:4], hard)
        local, label, inertia = mixture.fit_rows(x, 4, x[:4].copy(), hard=hard)
        rows = {r.id: r for r in mixture.predict(v, model).collect()}
        assert np.allclose(model.centres, local.centres, atol=1e-6) and [rows[i].label for i in range(400)] == label.tolist()
        assert abs(sum(r.inertia for r in rows.values()) - inertia) < 1e-6 and _same(label, of)
    fixed, _ = mixture.fit(v, x[:4], weights=[0.7, 0.1, 0.1, 0.1])
    assert fixed.weights.tolist() == [0.7, 0.1, 0.1, 0.1]
    assert mixture.fit(v.limit(0), x[:4])[1] == 0.0


def test_swapped_kmeans():
    x, of = _blobs(240, 6, 16, spread=0.1)
    w = np.linspace(0.5, 2, len(x))
    _, label, cost = partition.swapped_kmeans(x, w, 6)
    assert _same(label, of)
    best = min(partition.lloyd(x, w, partition.spread(x, w, 6, np.random.default_rng(s)), 100)[2] for s in range(20))
    assert cost <= best + 1e-9
    brute = []
    for i in range(len(x)):
        d = np.linalg.norm(x - x[i], axis=1)
        a = d[(label == label[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[label == c].mean() for c in set(label) - {label[i]})
        brute.append((b - a) / max(a, b))
    assert abs(partition.silhouette(x, label) - np.mean(brute)) < 1e-9
    assert partition.swapped_kmeans(np.ones((5, 2)), np.ones(5), 2)[2] == 0.0


def _quality(n, src, dst, w, size, label, resolution):
    rate = resolution * w.sum() / (size.sum() * (size.sum() - 1) / 2)
    inner = w[label[src] == label[dst]].sum()
    return inner - rate * sum(m * (m - 1) / 2 for m in np.bincount(label, size))


def test_communities_by_levels():
    rng = np.random.default_rng(3)
    of = np.repeat(np.arange(8), 12)
    pairs = [(i, j) for i in range(96) for j in range(i) if rng.random() < (0.6 if of[i] == of[j] else 0.02)]
    src, dst = (np.array(x) for x in zip(*pairs))
    w, size = np.ones(len(src)), np.ones(96)
    label = partition.communities(96, src, dst, w, size, 1.0)
    assert _quality(96, src, dst, w, size, label, 1.0) >= _quality(96, src, dst, w, size, of, 1.0) - 1e-9
    fixed = np.zeros(96, bool)
    fixed[[0, 1, 50]] = True
    held = partition.communities(96, src, dst, w, size, 1.0, fixed)
    assert len({held[0], held[1], held[50]}) == 3
    # each community hangs together
    inner = held[src] == held[dst]
    assert len(set(partition._connected(96, src[inner], dst[inner]))) == len(set(held))
    # small graphs against every partition
    def every(n):
        if n == 0:
            yield []
            return
        for rest in every(n - 1):
            for c in range(max(rest, default=-1) + 2):
                yield [*rest, c]

    good = 0
    for seed in range(20):
        r = np.random.default_rng(seed)
        p = [(i, j) for i in range(7) for j in range(i) if r.random() < 0.45]
        if not p:
            continue
        s, t = (np.array(x) for x in zip(*p))
        ww, sz = r.random(len(s)) + 0.1, r.integers(1, 4, 7).astype(float)
        best = max(_quality(7, s, t, ww, sz, np.array(c), 1.0) for c in every(7))
        got = _quality(7, s, t, ww, sz, partition.communities(7, s, t, ww, sz, 1.0), 1.0)
        assert got <= best + 1e-9
        good += got >= best - 0.05 * abs(best) - 1e-9
    assert good >= 15
    assert partition.communities(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.ones(3), 1.0).tolist() == [0, 1, 2]


def test_nodes_move_in_batches(monkeypatch):
    """Far fewer steps than nodes and few bytes an edge; at the end hardly any node gains by a move, and fixed ones are where they were."""
    import tracemalloc

    r, n = np.random.default_rng(5), 3000
    src = np.repeat(np.arange(n), 40)
    dst = np.where(r.random(len(src)) < 0.7, src // 30 * 30 + r.integers(0, 30, len(src)), r.integers(0, n, len(src)))
    src, dst = src[src > dst], dst[src > dst]
    w, size, fixed = r.random(len(src)) + 0.1, r.integers(1, 8, n).astype(float), np.arange(n) % 300 < 3
    tracemalloc.start()
    label = partition.communities(n, src, dst, w, size, 4.0, fixed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(src) and _quality(n, src, dst, w, size, label, 4.0) > 0.2 * w.sum()
    steps, ordered = [], partition._ordered
    monkeypatch.setattr(partition, "_ordered", lambda key: steps.append(len(key)) or ordered(key))
    rate = 4.0 * w.sum() / (size.sum() * (size.sum() - 1) / 2)
    label = partition._local_moves(*partition._both_ways(n, src, dst, w), size, fixed, np.arange(n), rate, np.random.default_rng(1))
    assert len(steps) < n / 2 and (label[fixed] == np.flatnonzero(fixed)).all()
    total = np.bincount(label, size, n)
    pull = np.zeros((n, n))
    np.add.at(pull, (src, label[dst]), w)
    np.add.at(pull, (dst, label[src]), w)
    gain = pull - rate * size[:, None] * (total[None] - (label[:, None] == np.arange(n)[None]) * size[:, None])
    now = gain[np.arange(n), label]
    near = pull > 0
    better = (np.where(near, gain, -np.inf).max(1) > np.maximum(now, 0) + 1e-9) | (now < -1e-9)
    assert better[~fixed].mean() < 0.02  # a community's size may have changed since, as always


def test_percentiles_are_sorted_for(spark):
    d = spark.createDataFrame([(float(x),) for x in np.random.default_rng(2).random(101)] + [(None,)], "x double")
    assert np.allclose(refine._percentiles(d, "x", (100, 50, 75, 33)), np.percentile([r.x for r in d.collect() if r.x is not None], (100, 50, 75, 33)))
    assert refine._percentiles(d.limit(0), "x", (100, 50)) == [-1.0, -1.0]


def test_grid(spark):
    rows = plans.queries()["grid_runs"](spark, SF).collect()
    assert len(rows) == 168 and len({r.run for r in rows}) == 168 and {r.contigs for r in rows} == {500}
    assert all(r.communities >= 10 for r in rows)  # ten nodes are fixed
    assert [refine.grid_rounds(n) for n in (1, 900_000, 950_000, 1_000_000)] == [-1, 30, 28, 24]


def test_grid_deals_no_edges_to_runs(spark):
    """Edges aren't copied for each run: its task reads them where they are written."""
    pairs = [(a, b, 0.1 + 0.01 * a) for g in (0, 10) for a in range(g, g + 4) for b in range(g, g + 4) if a != b]
    near = spark.createDataFrame([(a, b, d, 1 + (b - a) % 4) for a, b, d in pairs], "src long, dst long, d2 double, rank int")
    nodes = spark.createDataFrame([(i, 1 + i % 2, False) for i in (*range(4), *range(10, 15))], "id long, size long, fixed boolean")
    some = dict(resolutions=(1, 2), bandwidths=(0.1,), ratios=(100, 50), neighbours=(3, 2))
    found = refine.grid(near, nodes, **some)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    rows = found.collect()
    assert len(rows) == 8 * 9 and len({r.run for r in rows}) == 8
    ids = np.array([r[0] for r in nodes.collect()])
    for q, k in ((100, 3), (50, 2)):
        cut = np.percentile([d for a, b, d in pairs if 1 + (b - a) % 4 <= k], q)
        src, dst, d2 = (np.array(x) for x in zip(*sorted(p for p in pairs if p[0] > p[1] and 1 + (p[1] - p[0]) % 4 <= k and p[2] <= cut)))
        want = partition.communities(9, np.searchsorted(ids, src), np.searchsorted(ids, dst), np.exp(-d2 / 0.1), 1.0 + ids % 2, 2.0)
        of = {r.contig: r.community for r in rows if r.run == f"Leiden_embMat0_maxedges_{k}_partgraphRatio_{q}_resolution_2.0_bandwidth_0.1"}
        assert [of[i] for i in ids] == want.tolist()
    alone = refine.grid(near.limit(0), nodes, **some).collect()
    assert len(alone) == 8 * 9 and len({(r.run, r.community) for r in alone}) == 8 * 9
    assert refine.grid(near.limit(0), nodes.limit(0), **some).count() == 0


def test_grid_rounds_dont_follow_the_size(spark, monkeypatch):
    """A bound by the number of nodes doesn't end a run before a round brings nothing; one that is asked for does."""
    monkeypatch.setattr(refine, "grid_rounds", lambda n: 0)
    pairs = [(a, b, 0.1, 1) for g in (0, 4) for a in range(g, g + 4) for b in range(g, g + 4) if a != b]
    near = spark.createDataFrame(pairs, "src long, dst long, d2 double, rank int")
    nodes = spark.createDataFrame([(i, 1, False) for i in range(8)], "id long, size long, fixed boolean")
    some = dict(resolutions=(1,), bandwidths=(0.1,), ratios=(100,), neighbours=(3,))
    of = {r.contig: r.community for r in refine.grid(near, nodes, **some).collect()}
    assert len({of[i] for i in range(4)}) == len({of[i] for i in range(4, 8)}) == 1 and of[0] != of[4]
    assert len({r.community for r in refine.grid(near, nodes, **some, rounds=0).collect()}) == 8


def test_refinement(spark):
    """Levels, names and actions on a cluster of two genomes, a slightly contaminated one, a clean one and one without genes."""
    x, of = _blobs(40, 2, 16, spread=0.05)
    members = [("a", i, 2000 + i) for i in range(40)] + [("b", 100 + i, 30_000) for i in range(12)] + [("c", 200 + i, 1000) for i in range(6)] + [("d", 300, 5)]
    genes = [(i, f"g{i // 2 % 10}", 1) for i in range(20)] + [(100 + i, f"g{i}", 1) for i in range(10)] + [(110, "g0", 1)] + [(200, "g1", 1)]
    vecs = [(i, x[i].tolist()) for i in range(40)] + [(c, x[0].tolist()) for _, c, _ in members[40:]]
    sets = spark.createDataFrame([(0, f"g{i}") for i in range(10)] + [(1, f"h{i}") for i in range(4)], "set_id int, gene string")
    args = (spark.createDataFrame(members, "cluster string, contig long, len long"), spark.createDataFrame(vecs, "contig long, vec array<double>"), spark.createDataFrame(genes, "contig long, gene string, n long"), sets, sets.where("set_id = 5").unionByName(spark.createDataFrame([(9, "z")], "set_id int, gene string")))
    found, quality = refine.refine(*args)
    q = {r.cluster: r for r in quality.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r.cluster, set()).add(r.contig)
    assert set(got) == set(q) and {"a", "b", "c", "d"} <= set(q) and q["a"].level == 0
    assert round(q["a"].cont, 9) == 50.0 and round(q["b"].cont, 9) == 5.0 and q["c"].cont == q["d"].cont == 0.0
    parts = {frozenset(v) for k, v in got.items() if k.startswith("a.") and k.count(".") == 1}
    assert parts == {frozenset(i for i in range(40) if of[i] == c) for c in (0, 1)}  # the two genomes, each clean
    assert not any(k.startswith(("b.", "c.", "d.")) for k in q)  # exactly 5 % is kept
    more = args[2].unionByName(spark.createDataFrame([(111, "g3", 1)], "contig long, gene string, n long"))
    found, quality = refine.refine(args[0], args[1], more, *args[3:])
    b = {k: v for k, v in ((r.cluster, r.cont) for r in quality.collect()) if k.startswith("b")}
    assert round(b["b"], 9) == 10.0 and b["b.0"] == 0.0 and all(k.count(".") < 2 for k in b)  # allocated once, without learning
    assert {r.contig for r in found.where("cluster = 'b.0'").collect()} == {100 + i for i in range(10)}
    assert refine.refine(args[0].limit(0), *args[1:])[0].count() == 0


def test_knn_blocks(spark, monkeypatch):
    """Many small blocks give what one gives."""
    x, _ = _blobs(300, 5, 8)
    w = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    one = {(r.src, r.dst, r.rank) for r in vectors.knn(w, 4).collect()}
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    assert len(one) == 1200 and {(r.src, r.dst, r.rank) for r in vectors.knn(w, 4).collect()} == one


def test_knn_index(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS vec")
    exact = {(r.src, r.dst) for r in vectors.knn(v, 5).collect()}
    found = {(r.src, r.dst) for r in vectors.knn_index(v, 5).collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9
    x, _ = _blobs(2000, 20, 16)
    w = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    exact = {(r.src, r.dst) for r in vectors.knn(w, 5).collect()}
    assert len(exact & {(r.src, r.dst) for r in vectors.knn_index(w, 5).collect()}) / len(exact) >= 0.95


def test_kmers_of_other_codes(spark):
    rows = spark.createDataFrame([("acgN",), ("acRgt",), ("ACGTYACGT",), (None,), ("AC",), ("é ACGT",)], "text string").select(fn.sequence(F.col("text")).alias("seq"))
    got = {r.kmer: r.n for r in sequences.kmer_counts(rows, 4, canon=False).collect()}
    assert got == {"ACGA": 1, "ACGT": 3}  # N counts as A, words across R and Y aren't words
    assert {r.kmer for r in sequences.kmer_counts(rows, 2).collect()} == {"AC", "CG", "GA"} - {"GA"} | {"GA" if "GA" <= "TC" else "TC"}


def test_simulators(spark):
    random.seed(1)
    rows = spark.createDataFrame([(i, "".join(random.choice("ACGT") for _ in range(1000))) for i in range(30)] + [(99, "")], "id long, seq string")
    s, k = F.col("seq"), F.col("id")
    out = rows.select("id", "seq", fn.substituted(s, k, 0.1).alias("snv"), fn.inserted(s, k, 0.1, True).alias("ins"), fn.inserted(s, k, 0.1).alias("block"), fn.deleted(s, k, 0.1, True).alias("del"), fn.deleted(s, k, 0.1).alias("cut"), fn.augmented(s, k).alias("any"), fn.view(s, 100, k).alias("v")).where("id != 99").collect()
    for r in out:
        changed = sum(a != b for a, b in zip(r.seq, r.snv))
        assert len(r.snv) == 1000 and 50 < changed < 160 and 1050 < len(r.ins) < 1160 and 840 < len(r["del"]) < 950
        assert len(r.block) == 1101 and len(r.cut) == 899 and r.seq.startswith(r.cut[:1]) and r.seq.endswith(r.cut[-1:])
        assert r.v.seq == r.seq[r.v.start : r.v.end] and 99 <= len(r.v.seq) <= 1000
    assert rows.where("id = 99").select(fn.substituted(s, k, 0.1), fn.inserted(s, k, 0.1, True), fn.deleted(s, k, 0.1, True)).first()[:] == ("", "", "")


def test_epoch_turns(spark):
    rows = spark.range(100)
    assert sequences.epoch_order(rows, 10, 15, 1).select(F.max("turn")).first()[0] == 0  # 10 + 10 steps are enough for 15
    order = sequences.epoch_order(rows, 10, 35, 1).collect()
    assert {r.turn for r in order} == {0, 1, 2, 3} and all(sorted(r.id for r in order if r.turn == t) == list(range(100)) for t in range(4))


def test_unmatched(spark):
    seqs, known = spark.createDataFrame([("a", 0), ("b", 1)], "contig string, at long"), spark.createDataFrame([("b", 2.0)], "contig string, depth double")
    with pytest.raises(Exception, match="no depth of a"):
        sources.in_order(known, seqs).collect()
    hits = spark.createDataFrame([("x",)], "acc string")
    with pytest.raises(Exception, match="no model of x"):
        markers.with_models(hits, spark.createDataFrame([("y", 1)], "acc string, ga int")).collect()


def test_few_methods(spark):
    stats = spark.createDataFrame([("g", "a", 1, 2), ("g", "b", 2, 1), ("g", "c", 0, 0)], "grp string, method string, n905 long, total long")
    assert {r.method for r in selection.best_methods(stats, "grp", 3).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="too few methods"):
        selection.best_methods(stats, "grp", 4).collect()


def test_best_split():
    """The number of parts with the best silhouette, for both algorithms."""
    x, of = _blobs(90, 4, 16, spread=0.05)
    for which in ("flspp", "von"):
        assert _same(refine._best_split(x, np.ones(90), [2, 3, 4, 5, 6], which), of)


def test_depth_limits(spark):
    rows = spark.createDataFrame([(0, 1, 1500.0, 3.0), (0, 2, 10.0, 9.0), (1, 1, 40.0, 1.0)], "file int, contig long, mean double, std double")
    assert {(r.file, round(r["mean"], 3), round(r["std"], 3)) for r in depths.maxima(rows).collect()} == {(0, 750.0, 9.0), (1, 20.0, 1.0)}


def test_merged_chain(spark):
    """Pairs merge first; a merged number may meet a real one."""
    rows = [("c", "g", str(n), 10, *[n] * 6, n) for n in (1, 2, 3, 13)] + [("c", "h", "x1", 5, *[1] * 6, 0), ("d", "g", "7", 5, *[1] * 6, 0)]
    df = spark.createDataFrame(rows, "contig string, gene string, orf string, target_length long, hmm_from long, hmm_to long, ali_from long, ali_to long, env_from long, env_to long, at long")
    got = {(r.contig, r.gene, r.orf, r.target_length, r.hmm_from) for r in markers.merged_hits(df).collect()}
    assert got == {("c", "g", "3", 10, 3), ("c", "g", "1213", 30, 1), ("c", "h", "x1", 5, 1), ("d", "g", "7", 5, 1)}


def test_order_over_files(spark, tmp_path):
    """Of repeated names the last in the order of files counts, however large the files are."""
    for i, n in enumerate((3, 400_000, 2)):
        (tmp_path / f"{i}.fa").write_text(f">one\n{'ACGT' * n}\n" + f">n{i}\nAC\n")
    got = {r.name: len(r.seq) for r in sources.fasta(spark, str(tmp_path)).collect()}
    assert got == {"one": 8, "n0": 2, "n1": 2, "n2": 2}
    (tmp_path / "a.clan").write_text("# S\n#=GF ID   A\n#=GF AC   PF1.2\n#=GF WK   http://x//y\n#=GF CL   CL1\n//\n#=GF ID   B\n#=GF AC   PF2.1\n//\n")
    assert {(r.id, r.acc, r.clan) for r in sources.clans(spark, str(tmp_path / "a.clan")).collect()} == {("A", "PF1", "CL1"), ("B", "PF2", None)}


def test_shared_folder(spark):
    assert steps.folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def _slow_features(tokens, w):
    """The encoder token by token."""
    norm = lambda v, g: v / math.sqrt((v @ v) / len(v) + encoder.EPS) * g
    x = [t @ w["project"] + p for t, p in zip(tokens, w["positions"])]
    for layer in w["layers"]:
        n = [norm(v, layer["norm1"]) for v in x]
        width = len(n[0])
        qkv = [v @ layer["qkv"] + layer["qkv_bias"] for v in n]
        new = []
        for i in range(len(x)):
            heads = []
            for h in range(encoder.HEADS):
                c = slice(h * width // encoder.HEADS, (h + 1) * width // encoder.HEADS)
                s = np.array([qkv[i][:width][c] @ qkv[j][width : 2 * width][c] / math.sqrt(width / encoder.HEADS) for j in range(len(x))])
                s = np.exp(s) / np.exp(s).sum()
                heads.append(sum(s[j] * qkv[j][2 * width :][c] for j in range(len(x))))
            new.append(x[i] + np.concatenate(heads) @ layer["out"] + layer["out_bias"])
        x = []
        for v in new:
            n = norm(v, layer["norm2"])
            a = n @ layer["gate"]
            x.append(v + (a / (1 + np.exp(-a)) * (n @ layer["up"])) @ layer["down"])
    return np.array(x)


def test_encoder(spark):
    rng = np.random.default_rng(4)
    m = encoder.drawn_model(10, 5, 2, 3, 16, 2, 6, 7, small=(8, 8), multiple=16)
    for e in ("trained", "frozen"):
        m[e]["positions"] = rng.standard_normal((5, 16))
        for layer in m[e]["layers"]:
            layer["qkv_bias"] = rng.standard_normal(48)
    m["coverage"][0]["mean"], m["coverage"][0]["var"] = rng.standard_normal(16), rng.random(16) + 0.5
    tokens, dev, cov = rng.random((7, 5, 10)), rng.random((7, 2)), rng.random((7, 6))
    slow = np.array([_slow_features(t, m["trained"]) for t in tokens])
    assert np.allclose(encoder.features(tokens, m["trained"]), slow)
    want = []
    for f in slow:
        s = np.exp(f.mean(1))
        want.append((f * (s / s.sum())[:, None]).sum(0))
    assert np.allclose(encoder.pooled(slow), want)
    vecs = encoder.embedding(tokens, dev, cov, m)
    assert vecs.shape == (7, 6) and np.allclose(np.linalg.norm(vecs, axis=1), 1)
    df = spark.createDataFrame([(i, t.tolist(), x.tolist(), y.tolist()) for i, (t, x, y) in enumerate(zip(tokens, dev, cov))], "id long, tokens array<array<double>>, deviations array<double>, coverage array<double>").repartition(3)
    got = {r.id: r.vec for r in encoder.embed(df, m).collect()}
    assert np.allclose([got[i] for i in range(7)], vecs) and encoder.embed(df.limit(0), m).count() == 0
    assert [encoder.hidden(w) for w in (512, 768, 400)] == [512, 512, 512]
