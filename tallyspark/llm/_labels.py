"""What the two classifiers share: which rows may teach, a bounded sample of them, and logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3. A null id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def teaching_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of about bound labelled rows at most, half of each class if both have so many.

    Rows are chosen by a hash of their id against a share of all that the
    counts give, so the choice is the same in every run. Held-out ids, null
    ids and null labels are left out; an id with several labels counts by its
    largest. The chosen ids are broadcast: bound of them, whatever the input.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit("teach")), F.lit(1 << 30)) / float(1 << 30)
    few = F.lit(False)
    for value, size in sizes.items():
        few = few | ((F.col("label") == value) & (share < bound / 2 / size))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.where(few)), "doc_id").dropDuplicates(["doc_id"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic model without intercept, by Newton steps on the penalised loss."""
    w = np.zeros(x.shape[1])
    weights = np.ones(len(x)) if weights is None else weights
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weights * (p - y)) + penalty * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + (penalty + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w
