"""Mixture of von Mises-Fisher distributions: soft or hard expectation-maximisation, over a table or within a task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_KAPPA = 1e10


@dataclass
class Model:
    centres: np.ndarray
    weights: np.ndarray
    kappas: np.ndarray


def log_bessel(nu: float, x: np.ndarray) -> np.ndarray:
    """Logarithm of the modified Bessel function of the first kind: its power series, beyond 300 Hankel's expansion."""
    x = np.maximum(np.asarray(x, float), 1e-300)
    small = np.minimum(x, 300.0)
    j = np.arange(600)
    constant = np.array([-math.lgamma(i + 1) - math.lgamma(i + nu + 1) for i in j])
    terms = (2 * j + nu) * np.log(small / 2)[..., None] + constant
    top = terms.max(-1)
    series = top + np.log(np.exp(terms - top[..., None]).sum(-1))
    m, tail, term = 4 * nu * nu, np.ones_like(x), np.ones_like(x)
    for i in range(1, 8):
        term = term * -(m - (2 * i - 1) ** 2) / (i * 8 * np.maximum(x, 300.0))
        tail = tail + term
    return np.where(x <= 300, series, x - 0.5 * np.log(2 * np.pi * x) + np.log(np.maximum(tail, 1e-300)))


def _antiderivative(x: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    root = np.sqrt(x * x + beta * beta)
    return root - beta - (alpha * np.log((alpha + root) / (alpha + beta)) if alpha else 0.0)


def log_normaliser(kappa: np.ndarray, dim: int) -> np.ndarray:
    """What is taken from kappa times the cosine: exact up to 50 dimensions, beyond by the bound of the Bessel ratio (less a constant)."""
    nu, kappa = dim / 2 - 1, np.asarray(kappa, float)
    if dim <= 50:
        return dim / 2 * math.log(2 * math.pi) + log_bessel(nu, kappa) - nu * np.log(np.maximum(kappa, 1e-300))
    low = np.minimum(kappa, math.sqrt((3 * nu + 5.5) * (nu + 1.5)))
    return _antiderivative(kappa, nu + 0.5, nu + 0.5) + _antiderivative(low, nu, nu + 2) - _antiderivative(low, nu + 0.5, nu + 0.5)


def joint(x: np.ndarray, m: Model) -> np.ndarray:
    """log(weight * density) of each row and cluster."""
    with np.errstate(divide="ignore"):
        return np.log(m.weights)[None] + m.kappas[None] * (x @ m.centres.T) - log_normaliser(m.kappas, x.shape[1])[None]


def posterior(x: np.ndarray, m: Model, hard: bool = False) -> tuple[np.ndarray, float]:
    """Shares of the clusters in each row, and the log likelihood of all rows."""
    logs = joint(x, m)
    top = logs.max(1, keepdims=True)
    e = np.exp(logs - top)
    total = e.sum(1, keepdims=True)
    like = float((top + np.log(total)).sum())
    return (np.eye(len(m.weights))[logs.argmax(1)] if hard else e / total), like


def update(shares: np.ndarray, sums: np.ndarray, rows: int, weights: np.ndarray | None) -> Model:
    """The model from each cluster's summed shares and summed rows."""
    dim, length = sums.shape[1], np.linalg.norm(sums, axis=1)
    centres = np.where(length[:, None] > 1e-8, sums / np.maximum(length, 1e-300)[:, None], sums)
    w = shares / rows if weights is None else weights
    r = length / np.maximum(rows * w, 1e-300)
    near = np.abs(r - 1) < 1e-10
    kappas = np.where(near, MOST_KAPPA, (r * dim - r**3) / np.where(near, 1.0, 1 - r * r))
    return Model(centres, w, kappas)


def start(x: np.ndarray, k: int, init: str | np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """First centres at length one: spread over the rows (k-means++), random, random-orthonormal, of random classes, or given."""
    from .partition import spread

    dim = x.shape[1]
    if isinstance(init, np.ndarray):
        c = init
    elif init == "random":
        c = rng.standard_normal((k, dim))
    elif init == "random-orthonormal":
        c = np.linalg.qr(rng.standard_normal((dim, k)), mode="reduced")[0].T
    elif init == "random-class":
        c = np.zeros((k, dim))
        while (empty := np.flatnonzero(np.linalg.norm(c, axis=1) == 0)).size:
            of = rng.integers(0, k, len(x))
            c[empty] = [x[of == i].sum(0) for i in empty]
    elif init == "k-means++":
        c = spread(x, np.ones(len(x)), k, rng)
    else:
        raise ValueError(f"no start {init!r}")
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def fit_rows(x: np.ndarray, k: int, init: str | np.ndarray = "k-means++", seed: int = 3407, hard: bool = False, weights: np.ndarray | None = None, rounds: int = 300, tol: float = 1e-6) -> tuple[Model, np.ndarray, float]:
    """Model, labels and inertia (summed 1 - cosine to the own centre) of rows that fit into a task."""
    m = Model(start(x, k, init, np.random.default_rng(seed)), np.full(k, 1 / k) if weights is None else weights, np.ones(k))
    for _ in range(rounds):
        shares, _ = posterior(x, m, hard)
        new = update(shares.sum(0), shares.T @ x, len(x), weights)
        moved, m = ((new.centres - m.centres) ** 2).sum(), new
        if moved <= tol:
            break
    labels = shares.argmax(1)
    return m, labels, float((1 - (x * m.centres[labels]).sum(1)).sum())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def fit(v: DataFrame, centres: np.ndarray, hard: bool = False, weights: np.ndarray | None = None, rounds: int = 300, tol: float = 1e-6) -> tuple[Model, float]:
    """Model of ``v(id, vec)`` from first centres, and the log likelihood before the last step.

    A round is a pass over the table: each task adds up shares and rows of its own, k * (dim + 2) numbers, and those come together.
    """
    sc, k = v.sparkSession.sparkContext, len(centres)
    c = np.asarray(centres, float)
    weights = None if weights is None else np.asarray(weights, float)
    m, like = Model(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300), np.full(k, 1 / k) if weights is None else weights, np.ones(k)), 0.0

    def sums(at):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rows, like_ = np.zeros((k, at.value.centres.shape[1] + 1)), 0, 0.0
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("vec"))
                    shares, one = posterior(x, at.value, hard)
                    total += np.column_stack((shares.sum(0), shares.T @ x))
                    rows, like_ = rows + len(x), like_ + one
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([like_]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["rows", "likelihood", "total"])

        return run

    from pyspark.sql import functions as F

    for _ in range(rounds):
        parts = v.select("vec").mapInArrow(sums(sc.broadcast(m)), "rows long, likelihood double, total array<double>")
        each = parts.select("rows", "likelihood", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("rows").alias("rows"), F.sum("likelihood").alias("likelihood")).collect()  # k * (dim + 1) numbers
        if not each or not each[0].rows:
            return m, 0.0
        total = np.array([r.x for r in sorted(each, key=lambda r: r.i)]).reshape(k, -1)
        new = update(total[:, 0], total[:, 1:], each[0].rows, weights)
        moved, m, like = ((new.centres - m.centres) ** 2).sum(), new, each[0].likelihood
        if moved <= tol:
            break
    return m, like


def predict(v: DataFrame, m: Model) -> DataFrame:
    """id, label, p, likelihood, inertia of each row of ``v(id, vec)``: the likeliest cluster, its share, the log likelihood and 1 - cosine to its centre."""
    at = v.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vec"))
                logs = joint(x, at.value)
                label, top = logs.argmax(1), logs.max(1)
                like = top + np.log(np.exp(logs - top[:, None]).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(label, pa.int32()), pa.array(np.exp(top - like)), pa.array(like), pa.array(1 - (x * at.value.centres[label]).sum(1))], ["id", "label", "p", "likelihood", "inertia"])

    return v.select("id", "vec").mapInArrow(run, "id long, label int, p double, likelihood double, inertia double")
