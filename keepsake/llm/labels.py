"""Bounded samples of labelled rows, and small numeric tools for the models trained on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import is_held_out


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, the other columns of docs, y): at most `most` labelled rows outside the held-out fold, y 0 or 1.

    Which rows are taken depends on hashes of the id and the row alone, so a repeated id counts by its rows. A
    document with several labels has the largest; null labels and null ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    taken = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.join(F.broadcast(taken), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(*[c for c in docs.columns if c != "doc_id"])).limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, k = x.shape
    w, b = np.zeros(k), 0.0
    z, c, t = w.copy(), b, 1.0
    gram = x.T @ x / n if k <= n else x @ x.T / n
    step = 1 / (0.25 * (np.linalg.eigvalsh(gram)[-1] if k else 0) + 0.25)
    for _ in range(steps):
        g = sigmoid(x @ z + c) - y
        w1 = z - step * (x.T @ g) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = c - step * g.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, float(b)
