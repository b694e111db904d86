"""Substring de-duplication against brute force: repeated and null ids, long texts, runs of one letter, a whole table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from binloom.llm import substrings


def _brute(rows):
    seen, out = set(), []
    for i, t in rows:
        mark = bytearray(len(t))
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, m in zip(t, mark) if not m)
        out.append((i, len(t), sum(mark), sum(1 for k in range(len(t)) if mark[k] and (k == 0 or not mark[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _cases():
    random.seed(5)
    letters = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    parts = ["".join(random.choice("ab ") for _ in range(random.randint(60, 400))) for _ in range(6)]
    yield "shared", [(i, "".join(random.choice(parts)[random.randint(0, 50) : random.randint(60, 400)] for _ in range(random.randint(1, 8))) if i % 7 else "a" * (i * 13 % 700)) for i in range(60)]
    a, b, big = letters(300), letters(300), letters(1_300_000)
    yield "ids", [(1, a), (7, a), (7, b), (None, a), (None, b), (None, b), (1, a), (3, None), (4, ""), (None, None), (-(2**63), a + "x"), (2**63 - 1, "é" * 80)]
    yield "unrelated", [(1, a), (7, a), (7, b)]
    yield "short", [(i, "a" * i) for i in (0, 1, 7, 8, 9, 31, 32, 33)]
    yield "long", [(1, big), (2, "zz" + big[5000:600_000] + "yy"), (3, big[700_000:700_150]), (4, "a" * 1_200_000)]


@pytest.mark.parametrize("name, rows", list(_cases()))
def test_brute(spark, name, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    h = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.encode("text", "UTF-8")).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r]))
    got = sorted((tuple(r) for r in substrings.dedup(df).collect()), key=repr)
    assert got == _brute([(i, (t or "").encode()) for i, t in order])
    if name == "unrelated":
        assert {(r[0], r[2]) for r in got} == {(1, 0), (7, 300), (7, 0)}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in substrings.dedup(docs).collect()), key=repr)
    assert got == _brute(sorted((r.doc_id, r.text.encode()) for r in docs.collect()))
    kept = substrings.dedup(docs, text=True).where("n_removed > 0").first()
    assert hashlib.sha256(kept.kept).hexdigest() == kept.kept_sha256
