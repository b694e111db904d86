"""Every registered analytics query against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from binloom import plans
from binloom.operators import intervals, markers, sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, db, name):
    df = plans.queries()[name](spark, SF)
    want = db.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    norm = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = sorted((norm(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got and got == sorted(map(norm, want.select(",".join(f'"{c}"' for c in cols)).fetchall()), key=repr)


def test_interval_edges(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 2, 5), ("a", 10, 12), ("a", 0, 10), ("b", 3, 4), ("c", 5, 5)], "subject string, st long, en long")
    assert {r.subject: r.covered for r in intervals.breadth(rows, ["subject"]).collect()} == {"a": 12, "b": 1}
    runs = {(r.st, r.en): r.depth for r in intervals.depth_runs(rows.where("subject = 'a'"), ["subject"]).collect()}
    assert runs == {(0, 2): 2, (2, 5): 3, (5, 10): 2, (10, 12): 1}


def test_n50_boundary(spark):
    rows = spark.createDataFrame([(6,), (2,), (2,), (2,)], "len long")
    assert sequences.n50(rows).first().n50 == 6


def test_first_fit(spark):
    rows = spark.createDataFrame([(1, i, 100 - i, g) for i, g in enumerate([{"a": 1}, {"a": 1}, {"b": 2}, {"a": 1, "b": 1}])], "cluster long, contig long, len long, genes map<string,long>")
    assert {r.contig: r.group for r in markers.first_fit(rows).collect()} == {0: 0, 1: 1, 2: 0, 3: 2}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_clan_rivals(spark):
    rows = [("o", "PF1.1", "c", 1e-9, 1.0, 0, 10), ("o", "PF2.1", "c", 1e-8, 1.0, 5, 12), ("o", "PF3.1", "c", 1e-7, 1.0, 11, 20), ("o", "PF4.1", "d", 1e-6, 1.0, 0, 10), ("o", "PF5.1", "c", 1e-5, 1.0, 2, 4), ("o", "TIGR1", None, 1.0, 1.0, 0, 10), ("p", "PF2.1", "c", 1e-8, 1.0, 5, 12)]
    df = spark.createDataFrame(rows, "orf string, acc string, clan string, full_e double, i_e double, st long, en long")
    left = {(r.orf, r.acc) for r in markers.without_clan_rivals(df, [("PF1", "PF5")]).collect()}
    assert left == {("o", "PF1.1"), ("o", "PF3.1"), ("o", "PF4.1"), ("o", "PF5.1"), ("o", "TIGR1"), ("p", "PF2.1")}


def test_top_batches_ties(spark):
    rows = spark.createDataFrame([("d", 5), ("b", 5), ("a", 9), ("c", 5), ("e", 1)], "contig string, len long")
    assert {r.contig for r in sequences.top_batches(rows, 2).collect()} == {"a", "b", "c", "d"}
    assert {r.contig for r in sequences.top_batches(rows, 3).collect()} == {"a", "b", "c"}
    assert sequences.top_batches(rows, 6).count() == 0
