"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features are single words and pairs of neighbours, each as written (lower case) and as a shape (letters, capitals,
digits and marks, runs collapsed), hashed to ``BITS`` bits. A text's value of a feature is its count over the root of
the number of words; the score is the logistic function of the sparse dot product with the weights, over whole texts.

The model is fitted on the ``SAMPLE`` labelled documents of least hash among those with crc32(doc_id) mod 5 other than 0 (a
documented bound, the same at every size), in one task; its weights have a fixed size and are broadcast.

Odd cases: null and wordless texts score by the intercept alone. A null ``doc_id`` isn't held out and is never trained
on. Labels that are null, or of no document, are left out; repeated ones count once (the least label), as do documents that
share an id (the least text); a document whose labels differ counts as bad; none of these takes a place of the sample. Without any labels all scores are 0.5. Repeated documents give a row each. No documents, no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, BOOL, DBL, INT, LONG, own_columns, schema

BITS, SAMPLE, EPOCHS = 18, 6000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
THRESHOLD = 0.3
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58] = 97, 97, 65, 48
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers["up"] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE))))
        _powers["down"] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, inverse))))
    return _powers["up"], _powers["down"]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each occurrence as (n words, 4), and the words of each text; the last word of a text has no pair and gives feature -1 there."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[a]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _power(len(a))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[a] + np.uint64(1)) * up[: len(a)])))
    word = (total[ends] - total[starts]) * down[starts]
    shape = _SHAPE[a]
    kept = np.concatenate(([True], shape[1:] != shape[:-1]))
    kept[starts] = True
    rank = np.cumsum(kept) - 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(kept, (shape + np.uint64(1)) * up[rank], np.uint64(0)))))
    form = (total[ends] - total[starts]) * down[rank[starts]]
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    cuts = np.searchsorted(starts, edges)
    out = np.empty((len(starts), 4), np.int64)
    k = np.uint64(0x9FB21C651E98DF25)
    for j, h in ((0, word), (2, form)):
        out[:, j] = _mix(h, j)
        out[:, j + 1] = _mix(h * k + np.concatenate((h[1:], h[:1])), j + 1) if len(h) else 0
    out[cuts[1:][cuts[1:] > cuts[:-1]] - 1, 1::2] = -1
    return out, np.diff(cuts)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _parts(text: bytes) -> Iterator[np.ndarray]:
    """Features of a text's words in parts of bounded size, cut between words; a part begins with the last word of the one before it, for its pair only."""
    at, before = 0, b""
    while at < len(text):
        cut = _GAP.search(text, at + _CHUNK)
        end = cut.start() if cut else len(text)
        part = text[at:end].rstrip()
        found, _ = hashed([before + b" " + part if before else part])
        if before and len(found):
            found[0, ::2] = -1
        yield found
        if part:
            before = part[max(part.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1 :]
        at = end


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > _CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; coordinate 2**BITS is the intercept."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.full(len(z), L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    total: dict[int, int] = {}
    n = 0
    for found in _parts(text):
        n += int((found[:, 0] >= 0).sum())
        for i, c in zip(*(x.tolist() for x in np.unique(found[found >= 0], return_counts=True))):
            total[i] = total.get(i, 0) + c
    ids = np.array(sorted(total), np.int64)
    counts = np.array([total[i] for i in ids.tolist()], float)
    return np.append(ids, 1 << BITS), np.append(counts / np.sqrt(max(n, 1)), 1.0)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(_sparse(t or b""), y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist())]
    model = Ftrl()
    for _ in range(EPOCHS):
        for (i, x), y in rows:
            model.update(i, x, y)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()])], ["weights"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(model.value, "<f4").astype(float)
        bias, w = w[-1], np.append(w[:-1], 0.0)  # feature -1 weighs nothing
        for b in batches:
            scores = []
            for part in _chunks([t or b"" for t in b.column("text").to_pylist()]):
                if len(part) == 1 and len(part[0]) > _CHUNK:  # a long text
                    x, n = 0.0, 0
                    for found in _parts(part[0]):
                        x, n = x + w[found].sum(), n + int((found[:, 0] >= 0).sum())
                    scores.append(1 / (1 + np.exp(-np.clip(np.array([x / np.sqrt(max(n, 1)) + bias]), -35, 35))))
                    continue
                found, n = hashed(part)
                total = np.concatenate(([0.0], np.cumsum(w[found].sum(1))))
                ends = np.cumsum(n)
                x = (total[ends] - total[ends - n]) / np.sqrt(np.maximum(n, 1)) + bias
                scores.append(1 / (1 + np.exp(-np.clip(x, -35, 35))))
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """Weights and intercept, float32."""
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    mine = mine.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    mine = mine.join(own.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("h", "doc_id").limit(SAMPLE)  # ids with a document, each once
    rows = own.join(F.broadcast(mine), "doc_id").groupBy("h", "doc_id", "y").agg(F.min("text").alias("text"))  # SAMPLE rows, however often an id repeats
    rows = rows.repartition(1).sortWithinPartitions("h", "y", "doc_id").select("text", "y")
    found = rows.mapInArrow(_train, schema(weights=BIN)).first()
    return bytes(found[0]) if found else bytes(4 * ((1 << BITS) + 1))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return own.mapInArrow(_score(model), schema(doc_id=LONG, held_out=BOOL, score=DBL, predicted=INT))
