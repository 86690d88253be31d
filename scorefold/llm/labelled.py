"""Labelled rows for fitting, and a small fitter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scorefold.llm.common import filled, held_out
from scorefold.session import cut_lineage

MAX_TRAIN = 20_000  # labelled rows used for fitting, at most


def newton(X: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, loss: str, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a squared-hinge or logistic fit with a ridge."""
    X = np.column_stack([X, np.ones(len(X))])
    w, penalty = np.zeros(X.shape[1]), np.full(X.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        margin = y * (X @ w)
        if loss == "hinge":
            active = margin < 1
            g = X.T @ (weight * np.where(active, margin - 1, 0) * y) + penalty * w
            h = (X * (weight * active)[:, None]).T @ X
        else:
            p = 1 / (1 + np.exp(np.clip(margin, -30, 30)))
            g = -X.T @ (weight * p * y) + penalty * w
            h = (X * (weight * p * (1 - p))[:, None]).T @ X
        step = np.linalg.solve(h + np.diag(penalty + 1e-9), g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def training_rows(df: DataFrame, labels: DataFrame, label: str, text: str, key: str, folds: int) -> DataFrame:
    """Rows of at most MAX_TRAIN labelled keys outside the held-out fold, chosen by the hash of the key: k, text, y.

    Of different labels of one key the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key), folds))
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("k")).limit(MAX_TRAIN)
    # The labels are at most MAX_TRAIN rows of two numbers.
    return cut_lineage(df.select(F.col(key).alias("k"), filled(text).alias("text")).join(F.broadcast(known), "k").repartition(32), "training")
