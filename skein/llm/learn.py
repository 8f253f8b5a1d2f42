"""Bounded samples of labelled rows and a small logistic fit, shared by the trained operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, columns: list[str | Column], rows: int) -> pa.Table:
    """At most ``rows`` rows in the order of a hash of doc_id: the same ones at every partitioning.

    Only ids are ordered; the texts of the chosen rows alone reach the driver.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(ids), "doc_id").select("doc_id", *columns).dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression without intercept; y in {0, 1}."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (s * (p - y)) + ridge * w
        h = (x * (s * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
