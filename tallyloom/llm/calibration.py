"""A small logistic model that turns a few measures into a probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


def labelled(labels: DataFrame, label: str, key: str) -> DataFrame:
    """(k, y) of the labels 0 and 1 whose key is not null."""
    return labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1) and k is not null")


def texts_of(docs: DataFrame, keys: DataFrame, *, text: str, key: str) -> DataFrame:
    """(y, h, t) of the documents that ``keys`` (k, y) names: the label, a hash of the key and the text as bytes. Of documents
    that share a key, the one with the least text counts."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("t")).join(keys, "k")
    place = F.row_number().over(Window.partitionBy("k", "y").orderBy("t"))
    return rows.withColumn("place", place).where("place = 1").select("y", F.xxhash64(F.col("k").cast("string")).alias("h"), "t")


def draw(docs: DataFrame, labels: DataFrame, *, label: str, text: str, key: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample for a fit, (y, h, t) as in :func:`texts_of`, and the number of labels by class.

    Of each class the ``per_class`` labels with the least hash of the key are drawn, from the narrow label table; this list of
    at most twice ``per_class`` keys is broadcast, so the texts of other documents do not move.
    """
    known = labelled(labels, label, key)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.col("k").cast("string"))
    drawn = [known.where(F.col("y") == y).distinct().orderBy(order, "k").limit(per_class) for y in (0, 1)]
    return texts_of(docs, F.broadcast(drawn[0].union(drawn[1])), text=text, key=key), counts


#: Measures count up to this many standard deviations from their mean, so that none outweighs the others far off.
REACH = 3.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, measures: np.ndarray) -> np.ndarray:
        ready = np.clip((measures - self.mean) / self.spread, -REACH, REACH)
        return sigmoid(ready @ self.weights[:-1] + self.weights[-1])


def fit(measures: np.ndarray, labels: np.ndarray, importance: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> Logistic:
    """Newton steps on the weighted log loss; with one class only, a constant near its label."""
    mean, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-9
    x = np.c_[np.clip((measures - mean) / spread, -REACH, REACH), np.ones(len(measures))]
    w = np.zeros(x.shape[1])
    importance = importance / importance.mean()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (importance * (p - labels)) + penalty * len(x) * w
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + penalty * len(x) * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return Logistic(mean, spread, w)
