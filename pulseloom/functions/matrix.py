"""Matrices from Arrow columns, and sums of matrices over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of doubles, and which rows are whole: not null, and as long as ``width``. Others are 0, a null entry is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(column.value_lengths(), -1), np.int64)
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan), np.float64)
    good = size == width
    if good.all():
        return flat.reshape(-1, width), good
    out = np.zeros((len(size), width))
    out[good] = flat[np.repeat(good, np.maximum(size, 0))].reshape(-1, width)
    return out, good


def lists_of(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, without a Python object for an entry."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def matrix_sum(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part(batch)``, matrices of one shape, over all batches: one job, whatever the number of rows of the matrix.

    A task adds up its batches; the rows of the tasks' sums are then dealt out and added up by many tasks, and only the total,
    which must fit on the driver, reaches it.
    """
    schema = "i int, row binary"

    def sums(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], names=["i", "row"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(b)
                total = own if total is None else total + own
        if total is not None:
            yield sums(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b["i"].to_pylist(), b["row"].to_pylist()):
                total[i] = total.get(i, 0.0) + np.frombuffer(row)
        yield sums(total)

    out = np.zeros(shape)
    for r in df.mapInArrow(each, schema).repartition("i").mapInArrow(add, schema).collect():
        out[r["i"]] = np.frombuffer(r["row"])
    return out
