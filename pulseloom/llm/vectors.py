"""Vectors in Arrow batches, and blocked searches of queries against rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import keep
from .text import mix


def usable(column: str = "embedding") -> Column:
    """Not null, and no component null, infinite or not a number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of doubles; a shorter list is filled up with zeros, a longer one is not expected."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    size = np.asarray(column.value_lengths(), np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def unpack(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def search_blocks(
    queries: DataFrame, rows: DataFrame, width: int, k: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], slack: float, unit: bool = False
) -> DataFrame:
    """query_id, vec_id, score: for each block and lot the k best rows of the block for each query of the lot.

    ``queries`` (query_id, vector, lot, blocks: those it asks for) meet ``rows`` (block, vec_id, vector). A row is copied only
    to the lots that ask for its block, and blocks and lots have a bounded size. A product of matrices finds the candidates, with ``slack`` below the k-th so that rounding drops
    none; ``measure`` (pairs of rows) gives their scores. ``unit``: candidates are compared at length 1. Ties go to the
    smaller vec_id. A row with the query's own id is no candidate.
    """

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            right = right.sort_values("vec_id", ignore_index=True)
            x, ids = unpack(right["vector"], width), right["vec_id"].to_numpy()
            flat = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
            for a in range(0, len(left), 256):
                q, own = unpack(left["vector"][a : a + 256], width), left["query_id"].to_numpy()[a : a + 256]
                near = (q / np.linalg.norm(q, axis=1, keepdims=True) if unit else q) @ flat.T
                near[own[:, None] == ids[None, :]] = -np.inf
                top = min(k, near.shape[1])
                least = np.partition(near, -top, axis=1)[:, -top]
                i, j = np.nonzero((near >= (least - slack * (1 + np.abs(least)))[:, None]) & (near > -np.inf))
                found = pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": measure(q[i], x[j])})
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(found.groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})

    asking = keep(queries)
    asked = asking.select(F.explode("blocks").alias("block"), "lot")
    copied = rows.join(asked.distinct(), "block").select(F.col("block").alias("at"), F.col("lot").alias("by"), "vec_id", "vector")
    left = asking.select(F.explode("blocks").alias("block"), "lot", "query_id", "vector")
    return left.groupBy("block", "lot").cogroup(copied.groupBy("at", "by")).applyInPandas(solve, "query_id long, vec_id long, score double")


@dataclass
class Blocks:
    """Cells cut into blocks of at most about ``most`` rows, numbered end to end, and the queries at home in them into lots.

    A lot takes the queries of cells that stand side by side, ``lot`` of them at most, so that they ask for much the same
    blocks; a cell with more queries has several lots.
    """

    rows: np.ndarray
    queries: np.ndarray
    most: int
    lot: int

    def __post_init__(self):
        self.parts = np.maximum(1, -(-self.rows // self.most))
        self.first = np.cumsum(self.parts) - self.parts
        end = np.cumsum(self.queries)
        self.low = (end - self.queries) // self.lot
        self.lots = np.maximum(0, (end - 1) // self.lot - self.low) + 1

    def of_queries(self, query_id: np.ndarray, home: np.ndarray, asked: list[np.ndarray]) -> list[pa.Array]:
        """lot and blocks of each query, from the cell it is at home in and the cells it asks for."""
        lot = self.low[home] + (mix(query_id.astype(np.uint64)) % self.lots[home].astype(np.uint64)).astype(np.int64)
        blocks = [(np.repeat(self.first[c] - np.cumsum(self.parts[c]) + self.parts[c], self.parts[c]) + np.arange(self.parts[c].sum())) for c in asked]
        ends = np.cumsum([0, *map(len, blocks)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *blocks]).astype(np.int32)
        return [pa.array(lot.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

    def of_rows(self, vec_id: np.ndarray, cell: np.ndarray) -> pa.Array:
        part = (mix(vec_id.astype(np.uint64) + np.uint64(1)) % self.parts[cell].astype(np.uint64)).astype(np.int64)
        return pa.array((self.first[cell] + part).astype(np.int32))


def binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all blocks. Spark limits each task to k rows a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first on ties), and the distance."""
    apart = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
    at = apart.argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return run
