"""Bounded samples of labelled documents, for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id hashes as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """text and y (0 or 1) of at most ``most`` labelled documents, the first by a hash of the id.

    Only ids for which ``learn`` holds (a condition on doc_id) take part. The sample is bounded, so it is broadcast
    and the texts of all other documents stay where they are. A document with several labels takes the largest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    first = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = F.broadcast(first.withColumnRenamed("doc_id", "_id"))
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Rows of a design matrix that are worked off at once.
ROWS = 1024


class SparseRows:
    """A matrix (float32) by what is not 0 in each row; a slice of rows is made dense when it is asked for."""

    def __init__(self, many: np.ndarray, column: np.ndarray, value: np.ndarray, rest: np.ndarray, columns: int):
        """many: entries of each row; column, value: of all rows end to end, below ``columns``; rest: the columns that follow, dense."""
        self.ends, self.column, self.value, self.rest, self.columns = np.append(0, np.cumsum(many)), column, value, rest, columns
        self.shape, self.dtype = (len(many), columns + rest.shape[1]), np.dtype(np.float32)

    def __getitem__(self, rows: slice) -> np.ndarray:
        a, b, _ = rows.indices(self.shape[0])
        out = np.zeros((b - a, self.shape[1]), np.float32)
        own = slice(self.ends[a], self.ends[b])
        out[np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.column[own]] = self.value[own]
        out[:, self.columns :] = self.rest[a:b]
        return out


def _slices(n: int) -> list[slice]:
    return [slice(a, min(a + ROWS, n)) for a in range(0, n, ROWS)]


def product(x: np.ndarray | SparseRows, w: np.ndarray) -> np.ndarray:
    """x @ w, some rows at once."""
    return np.concatenate([np.zeros(0), *((x[i] @ w.astype(x.dtype)).astype(float) for i in _slices(x.shape[0]))])


def logistic(x: np.ndarray | SparseRows, y: np.ndarray, l2: float = 1.0, steps: int = 10) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; the last column of x is not penalised.

    Sums go over all rows, ``ROWS`` at once, so that no second matrix of x's size is made.
    """
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slope, bend = penalty * w, np.diag(penalty)
        for i in _slices(x.shape[0]):
            some = x[i]
            p = sigmoid((some @ w.astype(x.dtype)).astype(float))
            slope += ((p - y[i]).astype(x.dtype) @ some).astype(float)
            some = some * np.sqrt(p * (1 - p) + 1e-9).astype(x.dtype)[:, None]
            bend += (some.T @ some).astype(float)
        step = np.clip(np.linalg.solve(bend, slope), -5, 5)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w
