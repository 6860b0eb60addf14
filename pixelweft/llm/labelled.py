"""What the two text classifiers share: the labelled sample, folds and calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold() -> Column:
    """crc32 of the doc_id as text, modulo FOLDS; 0 is held out. A null id has fold -1 and is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, text: str = "text") -> pd.DataFrame:
    """At most each labelled rows of either label outside the held-out fold, as (doc_id, text, y, weight), in a fixed order.

    The rows are those whose ids have the smallest hashes, so the sample is the same
    on every run and bounded at any size of the corpus. Ids with both labels, and
    null labels, are left out; of the texts of one id the first in order is taken.
    weight is the number of labelled ids that a row of its label stands for.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold() > 0)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).where("y = most").drop("most")
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(each)
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").cast("int").alias("y"))
    found = rows.toPandas().sort_values("doc_id").reset_index(drop=True)
    all_of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    found["weight"] = [max(1.0, all_of.get(y, 0) / (found.y == y).sum()) for y in found.y]
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and intercept (last) of a logistic regression by Newton's method; Platt scaling if x has one column."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, c = np.zeros(a.shape[1]), np.ones(len(x)) if weight is None else weight
    ridge = l2 * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (c * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x) @ w[:-1] + w[-1], -30, 30)))
