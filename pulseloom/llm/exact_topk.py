"""Exact top-k by a Voronoi join: cells around pivots, bounds from cell summaries, and only the needed blocks.

Score is the inner product. For a row x of the cell of pivot p, |q.x - q.p| <= |q| |x - p|. Each cell is summarised by
its count, its radius and its few smallest distances to the pivot. A query's k-th best score is at least the k-th
largest of q.p - |q| d over those distances (of as many more as its id has rows); a cell whose q.p + |q| radius is below that
holds no answer, and the query is not sent there. Cells are cut into blocks of bounded size, queries into lots by the
cell they lie in, a row is copied to the lots that ask for its block, and a block is searched locally.

Nulls: rows whose vector is null or has a null or non-finite component take no part, nor do rows with a null id.
Repeated ids: as a query an id counts once (its smallest vector); as candidates all its rows count but for its own.
Shorter vectors are filled up with zeros. Whole components are exact while scores stay below 2^53.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Blocks, binary, matrix, nearest, per_batch, ranked, search_blocks, usable


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * x).sum(axis=1)


def block_size(rows: int) -> int:
    """Rows of a block: about twice the square root, so that blocks and block size grow together; bounded for memory."""
    return min(65_536, max(256, 2 * math.isqrt(rows)))


def side_by_side(x: np.ndarray) -> np.ndarray:
    """An order of the rows of x in which each is followed by the nearest of those left."""
    left = np.ones(len(x), bool)
    order = [0]
    left[0] = False
    for _ in range(len(x) - 1):
        apart = np.where(left, ((x - x[order[-1]]) ** 2).sum(axis=1), np.inf)
        order.append(int(apart.argmin()))
        left[order[-1]] = False
    return np.array(order)


def exact_topk(table: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None, lot: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (double) of the k largest inner products of each query with all other rows.

    ``table`` has vec_id and embedding (array of numbers). The pivots are the rows first by a hash of the id (any choice
    gives the same result): ``pivots`` of them, or half the square root of the rows, 64 to 4096. The driver holds the pivots
    and one summary row per pivot.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = table.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.count_if("asks").alias("q")).first()
    if not size["n"] or not size["q"]:
        return spark.createDataFrame([], schema)
    width = max(1, size["width"])
    pivots = pivots or min(4096, max(64, math.isqrt(size["n"]) // 2))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).toArrow()
    centres = np.unique(matrix(chosen["embedding"], width), axis=0)
    centres = centres[side_by_side(centres)]

    def summarise(b: pa.RecordBatch) -> pa.RecordBatch:
        at, d = nearest(matrix(b["embedding"], width), centres)
        asks = np.asarray(b["asks"].to_numpy(zero_copy_only=False), bool)
        out = [(int(c), int((own := at == c).sum()), int(asks[own].sum()), float(d[own].max()), np.sort(d[own])[: k + 1].tolist()) for c in np.unique(at)]
        return pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["cell", "n", "q", "radius", "least"]))

    least = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k + 1)
    part = rows.mapInArrow(per_batch(summarise), "cell long, n long, q long, radius double, least array<double>")
    for keys in (["cell", "part"], ["cell"]):  # in two steps, so that no group gathers a row from every batch
        part = part.withColumn("part", F.pmod(F.xxhash64("radius", "n"), F.lit(64))) if len(keys) == 2 else part
        part = part.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.max("radius").alias("radius"), least("least").alias("least"))
    summary = {r["cell"]: r for r in part.collect()}
    cells = np.array(sorted(summary))
    radius = np.array([summary[c]["radius"] for c in cells])
    place = np.repeat(np.arange(len(cells)), [len(summary[c]["least"]) for c in cells])
    smallest = np.concatenate([summary[c]["least"] for c in cells])
    blocks = Blocks(*(np.array([summary[c][x] for c in cells], np.int64) for x in ("n", "q")), block_size(size["n"]), lot)
    middles = centres[cells]

    def needed(b: pa.RecordBatch) -> pa.RecordBatch:
        q, own = matrix(b["embedding"], width), np.asarray(b["own"], np.int64)
        norm, asked = np.linalg.norm(q, axis=1), []
        for a in range(0, len(q), 64):
            length, inner = norm[a : a + 64, None], q[a : a + 64] @ middles.T
            floors = -np.sort(-(inner[:, place] - length * smallest[None, :]), axis=1)
            # the query's own rows may be among them, so as many more than k
            nth = k - 1 + own[a : a + 64]
            bound = np.where(nth < floors.shape[1], floors[np.arange(len(floors)), np.minimum(nth, floors.shape[1] - 1)], -np.inf)
            bound = bound - 1e-9 * (1 + np.abs(bound) + length[:, 0] * (np.abs(centres).max() + 1) * width)
            asked += [np.flatnonzero(x) for x in inner + length * radius[None, :] >= bound[:, None]]
        ids = np.asarray(b["query_id"], np.int64)
        return pa.RecordBatch.from_arrays([b["query_id"], binary(q), *blocks.of_queries(ids, nearest(q, middles)[0], asked)], names=["query_id", "vector", "lot", "blocks"])

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b["embedding"], width)
        cell = np.searchsorted(cells, nearest(x, centres)[0])
        return pa.RecordBatch.from_arrays([blocks.of_rows(np.asarray(b["vec_id"], np.int64), cell), b["vec_id"], binary(x)], names=["block", "vec_id", "vector"])

    asked = rows.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("own"))
    queries = asked.mapInArrow(per_batch(needed), "query_id long, vector binary, lot int, blocks array<int>")
    data = rows.mapInArrow(per_batch(placed), "block int, vec_id long, vector binary")
    found = ranked(search_blocks(queries, data, width, k, _dot, 1e-12), k)
    return found.select("query_id", "rank", "vec_id", "score")
