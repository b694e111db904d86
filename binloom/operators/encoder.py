"""Inference of the contig encoder and of the contrastive model over a table, in numpy; weights come from elsewhere or are drawn.

Batches of rows go through the model in each task; the weights, of a size that follows from the model's shape, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADS, MULTIPLE, EPS = 8, 256, 1e-6
#: Rows that go through a model together.
ROWS = 256


def hidden(width: int, multiple: int = MULTIPLE) -> int:
    """Inner width of a gated layer: two thirds, rounded up to a multiple."""
    return -(-int(2 * width / 3) // multiple) * multiple


def drawn(words: int, width: int, layers: int, tokens: int, rng: np.random.Generator, multiple: int = MULTIPLE) -> dict:
    """Weights of an encoder as training starts with them."""
    one = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(shape[0])
    inner = hidden(width, multiple)
    layer = lambda: {"norm1": np.ones(width), "qkv": one(width, 3 * width), "qkv_bias": np.zeros(3 * width), "out": one(width, width), "out_bias": np.zeros(width), "norm2": np.ones(width), "gate": one(width, inner), "up": one(width, inner), "down": one(inner, width)}
    return {"project": one(words, width), "positions": np.zeros((tokens, width)), "layers": [layer() for _ in range(layers)]}


def drawn_mlp(widths: tuple[int, int, int], rng: np.random.Generator) -> dict:
    a, b, c = widths
    one = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(shape[0])
    return {"in": one(a, b), "mean": np.zeros(b), "var": np.ones(b), "scale": np.ones(b), "shift": np.zeros(b), "out": one(b, c)}


def rms_norm(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).mean(-1, keepdims=True) + EPS) * weight


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def attention(x: np.ndarray, w: dict) -> np.ndarray:
    """Every token sees all tokens of its row, in HEADS parts of the width."""
    rows, tokens, width = x.shape
    q, k, v = np.moveaxis((x @ w["qkv"] + w["qkv_bias"]).reshape(rows, tokens, 3, HEADS, width // HEADS), 2, 0)
    share = softmax(np.einsum("bihc,bjhc->bhij", q, k) / np.sqrt(width // HEADS), -1)
    return np.einsum("bhij,bjhc->bihc", share, v).reshape(rows, tokens, width) @ w["out"] + w["out_bias"]


def gated(x: np.ndarray, w: dict) -> np.ndarray:
    a = x @ w["gate"]
    return (a / (1 + np.exp(-a)) * (x @ w["up"])) @ w["down"]


def features(tokens: np.ndarray, w: dict) -> np.ndarray:
    """Token features (row, token, width) of composition tokens (row, token, word)."""
    x = tokens @ w["project"] + w["positions"][: tokens.shape[1]]
    for layer in w["layers"]:
        x = x + attention(rms_norm(x, layer["norm1"]), layer)
        x = x + gated(rms_norm(x, layer["norm2"]), layer)
    return x


def pooled(x: np.ndarray) -> np.ndarray:
    """One vector a row: tokens weighed by the softmax of their means."""
    return (x * softmax(x.mean(-1, keepdims=True), 1)).sum(1)


def mlp(x: np.ndarray, w: dict) -> np.ndarray:
    """Two layers with normalisation by the running mean and variance between them."""
    y = (x @ w["in"] - w["mean"]) / np.sqrt(w["var"] + 1e-5) * w["scale"] + w["shift"]
    return np.maximum(y, 0) @ w["out"]


def embedding(tokens: np.ndarray, deviations: np.ndarray, coverage: np.ndarray, m: dict) -> np.ndarray:
    """Vectors at length one from the trained and the frozen encoder, coverage composition and deviations of depth.

    ``m``: ``trained`` and ``frozen`` encoders; ``coverage`` and ``deviations``, each a pair of an mlp and a matrix; ``projector``, two mlps and a matrix.
    """
    parts = [pooled(features(tokens, m["trained"])), pooled(features(tokens, m["frozen"]))]
    parts += [mlp(x, m[name][0]) @ m[name][1] for name, x in (("coverage", coverage), ("deviations", deviations))]
    first, second, last = m["projector"]
    y = mlp(mlp(np.concatenate(parts, 1), first), second) @ last
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def drawn_model(words: int, tokens: int, files: int, whole: int, width: int, layers: int, out: int, seed: int, small: tuple[int, int] = (512, 1024), multiple: int = MULTIPLE) -> dict:
    """Weights of a contrastive model as training starts with them; ``small``: widths of the parts for deviations and coverage."""
    rng = np.random.default_rng(seed)
    d, c = small
    one = lambda a, b: rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
    encoder = lambda: drawn(words, width, layers, tokens, rng, multiple)
    return {"trained": encoder(), "frozen": encoder(), "deviations": (drawn_mlp((files, d // 2, d), rng), one(d, d)), "coverage": (drawn_mlp((files * whole, 2 * c, c), rng), one(c, c)), "projector": (drawn_mlp((2 * width + c + d, 8 * width, 6 * width), rng), drawn_mlp((6 * width, 4 * width, 2 * width), rng), one(2 * width, out))}


def embed(rows: DataFrame, model: dict) -> DataFrame:
    """id, vec of ``rows(id, tokens array<array<double>>, deviations array<double>, coverage array<double>)``; all rows have as many tokens."""
    at = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                matrix = lambda c: np.array(b.column(c).to_pylist(), float)  # noqa: E731, B023
                y = embedding(matrix("tokens"), matrix("deviations"), matrix("coverage"), at.value)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(y.tolist(), pa.list_(pa.float64()))], ["id", "vec"])

    return rows.select("id", "tokens", "deviations", "coverage").mapInArrow(run, "id long, vec array<double>")


def best_epoch(losses: DataFrame) -> DataFrame:
    """run, epoch, loss: the epoch of least validation loss in the second half of each run; ``losses(run, epoch, epochs, loss)``."""
    late = losses.where(F.col("epoch") > F.expr("epochs div 2"))
    return late.groupBy("run").agg(F.min(F.struct("loss", "epoch")).alias("x")).select("run", "x.epoch", "x.loss")
