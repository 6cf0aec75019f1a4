"""Linear models over sparse indicator features, fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def training_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: not held out, with an id, labelled 0 or 1; one per id."""
    able = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    return able.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` training rows for each of the labels 0 and 1.

    The rows with the smallest id hashes are taken, so the choice does not depend on how tables are
    stored. Held-out rows, rows without doc_id and labels other than 0 and 1 are left out. The chosen
    ids are at most twice `most`, so they are broadcast and no text is shuffled.
    """
    able = training_rows(labels, label)
    rank = F.xxhash64("doc_id")
    some = [able.where(F.col("label") == v).orderBy(rank, "doc_id").limit(most) for v in (0, 1)]
    ids = some[0].unionByName(some[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit_hinge(rows: Sequence[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent (Hsieh et al., 2008).

    rows hold the indices of each row's active features; a feature's value is its scale. The bias is a
    feature of value one. Classes weigh alike. Returns (weights times scale, bias).
    """
    y = np.where(labels == 1, 1.0, -1.0)
    share = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    upper = np.where(y > 0, cost * len(y) / (2 * share[0]), cost * len(y) / (2 * share[1]))
    norm = np.array([1.0 + float((scale[r] ** 2).sum()) for r in rows])
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(rows)):
            r = rows[i]
            gradient = y[i] * (float(w[r] @ scale[r]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * scale[r]
                bias += step
                most = max(most, abs(step))
        if most < 1e-6:
            break
    return w * scale, bias


def fit_logistic_scale(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) are probabilities, classes weighing alike (Platt scaling)."""
    n = (labels == 1).sum(), (labels == 0).sum()
    t = np.where(labels == 1, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
    c = np.where(labels == 1, 0.5 / max(1, n[0]), 0.5 / max(1, n[1]))
    x, v = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -500, 500)))
        g, h = x.T @ (c * (p - t)), (x.T * (c * np.maximum(p * (1 - p), 1e-6))) @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        v = v - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(v[0]), 1e-3), float(v[1])


def probability(margins: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
