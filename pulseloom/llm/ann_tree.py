"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most ``sample`` rows, or five for each leaf (documented bounds); every row is then put into its leaf. A query walks
the tree with a priority queue of nodes by distance to their centres and takes leaves in that order. How many leaves
is calibrated: for ``probes`` rows the true neighbours among all rows are found by brute force, and the number of
leaves is widened until the wanted share of them lies in the leaves taken. Leaves number four times the square root of
the rows, 16,384 at most. A leaf is cut into blocks of bounded size; queries go in lots by the leaf they lie in, and a row
is copied to the lots that ask for its block.

Nulls: rows whose vector is null, all zero, or has a null or non-finite component take no part, nor do null ids.
Repeated ids: as a query an id counts once (its smallest vector); as candidates all its rows count but for its own.
Shorter vectors are filled up with zeros.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_topk import block_size
from .vectors import Blocks, binary, matrix, nearest, per_batch, ranked, search_blocks, usable


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


@dataclass
class Tree:
    """children[i]: the nodes below node i, none for a leaf; leaves are numbered in leaf."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the tree by the nearest centre."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = [n for n in np.unique(node) if len(self.children[n])]
            if not inner:
                return self.leaf[node]
            for n in inner:
                here = np.flatnonzero(node == n)
                node[here] = self.children[n][nearest(x[here], self.centres[self.children[n]])[0]]

    def visits(self, q: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves best bin first: at least ``leaves`` of them, and more while they hold fewer than ``rows`` rows."""
        apart = ((self.centres - q) ** 2).sum(axis=1)
        queue, out, total = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or total < rows):
            _, n = heapq.heappop(queue)
            if len(self.children[n]):
                for c in self.children[n]:
                    heapq.heappush(queue, (apart[c], int(c)))
            else:
                out.append(int(self.leaf[n]))
                total += int(self.rows[self.leaf[n]]) if len(self.rows) else 0
        return out


def fit_tree(x: np.ndarray, branch: int = 8, leaf: int = 40, most: int = 1024, rounds: int = 12) -> Tree:
    """Split the largest node again and again by k-means, until nodes are small or there are ``most`` leaves."""
    random = np.random.default_rng(7)
    centres, children = [x.mean(axis=0)], [np.zeros(0, np.int64)]
    queue = [(-len(x), 0, np.arange(len(x)))]
    done = 1
    while queue and done + branch - 1 <= most:
        n, node, rows = heapq.heappop(queue)
        if -n <= leaf:
            break
        own = x[rows]
        distinct = np.unique(own, axis=0)
        if len(distinct) < 2:
            continue
        c = distinct[random.choice(len(distinct), min(branch, len(distinct)), replace=False)]
        for _ in range(rounds):
            at, _ = nearest(own, c)
            new = np.array([own[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
            if np.allclose(new, c):
                break
            c = new
        at, _ = nearest(own, c)
        used = np.unique(at)
        if len(used) < 2:
            continue
        children[node] = np.arange(len(centres), len(centres) + len(used))
        for i in used:
            heapq.heappush(queue, (-int((at == i).sum()), len(centres), rows[at == i]))
            centres.append(c[i])
            children.append(np.zeros(0, np.int64))
        done += len(used) - 1
    is_leaf = np.array([not len(c) for c in children])
    return Tree(np.array(centres), children, np.where(is_leaf, np.cumsum(is_leaf) - 1, -1))


def approximate_topk(
    table: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, sample: int = 20_000, probes: int = 128, lot: int = 4096
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine in double precision) of each query's k nearest rows found."""
    spark = table.sparkSession
    rows = table.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable() & F.exists("embedding", lambda x: x != 0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.count_if("asks").alias("q")).first()
    if not size["n"] or not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = size["width"]
    most = min(16_384, max(64, 4 * math.isqrt(size["n"])))
    sample = max(sample, 5 * most)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toArrow()
    points = matrix(drawn["embedding"], width)
    tree = fit_tree(_unit(points), leaf=max(5, min(40, len(points) // most)), most=most)

    # the probes' true neighbours among all rows: each batch offers its k best, with their leaves
    probe, own = points[:probes], np.asarray(drawn["vec_id"], np.int64)[:probes]

    def offer(b: pa.RecordBatch) -> pa.RecordBatch:
        x, ids = _unit(matrix(b["embedding"], width)), np.asarray(b["vec_id"], np.int64)
        near = _unit(probe) @ x.T
        near[own[:, None] == ids[None, :]] = -np.inf
        top = min(k, len(ids))
        j = np.argpartition(-near, top - 1, axis=1)[:, :top]
        i = np.repeat(np.arange(len(probe)), top)
        j = j.ravel()
        good = near[i, j] > -np.inf
        i, j = i[good], j[good]
        leaf = tree.assign(x[j]) if len(j) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[j]), pa.array(near[i, j]), pa.array(leaf)], names=["query_id", "vec_id", "score", "leaf"])

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        leaf, at = np.unique(tree.assign(_unit(matrix(b["embedding"], width))), return_inverse=True)
        asks = np.bincount(at, weights=b["asks"].to_numpy(zero_copy_only=False), minlength=len(leaf)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.bincount(at)), pa.array(asks)], names=["leaf", "n", "q"])

    counted = rows.mapInArrow(per_batch(count), "leaf long, n long, q long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).collect()
    tree.rows, asking = np.zeros((2, tree.leaves), np.int64)
    for r in counted:
        tree.rows[r["leaf"]], asking[r["leaf"]] = r["n"], r["q"]
    true = ranked(rows.mapInArrow(per_batch(offer), "query_id long, vec_id long, score double, leaf long"), k).collect()
    order = [{leaf: at for at, leaf in enumerate(tree.visits(q, tree.leaves, 0), 1)} for q in _unit(probe)]
    depth = np.sort([order[r["query_id"]][r["leaf"]] for r in true])
    leaves = int(depth[max(0, math.ceil(recall * len(depth)) - 1)]) if len(depth) else tree.leaves

    blocks = Blocks(tree.rows, asking, block_size(size["n"]), lot)

    def walk(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b["embedding"], width)
        unit = _unit(x)
        # rows of the query's own id do not count as found
        asked = [np.array(tree.visits(q, leaves, k + own)) for q, own in zip(unit, b["own"].to_pylist())]
        ids = np.asarray(b["query_id"], np.int64)
        return pa.RecordBatch.from_arrays([b["query_id"], binary(x), *blocks.of_queries(ids, tree.assign(unit), asked)], names=["query_id", "vector", "lot", "blocks"])

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b["embedding"], width)
        return pa.RecordBatch.from_arrays([blocks.of_rows(np.asarray(b["vec_id"], np.int64), tree.assign(_unit(x))), b["vec_id"], binary(x)], names=["block", "vec_id", "vector"])

    asked = rows.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("own"))
    queries = asked.mapInArrow(per_batch(walk), "query_id long, vector binary, lot int, blocks array<int>")
    data = rows.mapInArrow(per_batch(placed), "block int, vec_id long, vector binary")
    found = ranked(search_blocks(queries, data, width, k, _cosine, 1e-9, unit=True), k)
    return found.select("query_id", "rank", "vec_id", "score")
