"""The labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, stage

#: Labelled rows that a classifier is fitted on at most; ids in hash order decide which.
TRAIN_ROWS = 20_000


def held_out(column: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return id_crc(column) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled rows that aren't held out, staged.

    Which rows, is settled on the ids alone, so the join's small side is bounded by ``most``. Null ids and labels are
    left out; of several labels of an id the greatest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stage(own.join(F.broadcast(ids), "doc_id"), "labelled")


def logistic(x, y, ridge: float = 1e-3, steps: int = 50):
    """Weights (the intercept last) of a logistic regression by Newton's method; rows of ``x`` are samples."""
    import numpy as np

    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * len(y) * np.r_[w[:-1], 0]
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(y) * np.diag(np.r_[np.ones(len(w) - 1), 1e-6]) + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w
