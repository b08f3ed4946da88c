"""Labelled rows: folds, joins and bounded samples for the classifiers."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels are broadcast up to so many rows (16 bytes each); a larger table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out (a null id's is 1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(1))


def fold_of(doc_id: int | None) -> int:
    return 1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def usable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, fold) of the rows to learn from: one for each id that isn't held out, its largest label in 0 and 1."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.withColumn("fold", fold()).where("fold <> 0")


def join_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * x + b))), by Newton steps on lightly penalised likelihood."""
    mean = float(np.average(x, weights=weight)) if len(x) else 0.0
    scale = float(np.sqrt(np.average((x - mean) ** 2, weights=weight))) if len(x) else 0.0
    scale = scale or 1.0
    z = (x - mean) / scale
    w = np.zeros(2)
    features = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (y - p)) - np.array([1e-3, 0]) * w
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        size = float(np.abs(step).max())
        w += step if size < 4 else step * 4 / size
        if size < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)
