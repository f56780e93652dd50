"""Arrays in .npy files as a Spark data source, read in parallel by ranges of rows.

``spark.read.format("waves")`` takes a file or a folder of files. A file is one array of recordings, (N, 1, T, C) or (N, T, C)
with the layout "samples", (N, C, T) or (N, 1, C, T) with "leads". The driver reads headers alone; each partition reads the bytes of its own rows
at their place, ``at_once`` at a time, so a file of any size is many tasks' work and is never in memory as a whole.

Options: ``layout``, ``fs`` (the rate, which the file hasn't got), ``leads`` (numbers, such as "0,1,6": only these are
returned, and with the layout "leads" only their bytes are read), ``bytes`` of a partition, ``at_once`` (bytes in memory).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shared import shared_dir

SCHEMA = "file string, record_id long, seg_idx int, fs int, signal array<array<float>>"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def read_header(source) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the values begin."""
    version = np.lib.format.read_magic(source)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, turned, kind = read(source)
    if turned and len(shape) > 1 or kind.hasobject:
        raise ValueError("only arrays of numbers in C order can be read by rows")
    return shape, kind, source.tell()


@dataclass
class Rows(InputPartition):
    """Rows [low, high) of a file whose values begin at ``start``."""

    path: str
    shape: tuple[int, ...]
    kind: str
    start: int
    low: int
    high: int


class WaveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layout = options["path"], options.get("layout", "samples")
        if self.layout not in ("samples", "leads"):
            raise ValueError(f"no such layout: {self.layout}")
        self.fs, self.leads = options.get("fs"), [int(x) for x in options["leads"].split(",")] if options.get("leads") else None
        self.bytes, self.at_once = int(options.get("bytes", 64 << 20)), int(options.get("at_once", 16 << 20))

    def partitions(self) -> list[Rows]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        files = [path] if info.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.path.endswith(".npy"))
        out: list[Rows] = []
        for name in files:
            with system.open_input_file(name) as source:
                shape, kind, start = read_header(source)
            if len(shape) == 4 and shape[1] == 1:
                shape = (shape[0], *shape[2:])
            if len(shape) != 3:
                raise ValueError(f"{name}: an array of recordings has 3 axes, or 4 with a second one of length 1; this one is {shape}")
            step = max(1, self.bytes // max(1, math.prod(shape[1:]) * kind.itemsize))
            out += [Rows(name, shape, kind.str, start, a, min(a + step, shape[0])) for a in range(0, shape[0], step)]
        return out or [Rows("", (0, 0, 0), "<f4", 0, 0, 0)]

    def read(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        if rows.low == rows.high:
            return
        kind, (_, a, b) = np.dtype(rows.kind), rows.shape
        row = a * b * kind.itemsize
        step = max(1, self.at_once // max(1, row))
        system, _ = file_system(self.path)
        with system.open_input_file(rows.path) as source:
            for low in range(rows.low, rows.high, step):
                n = min(step, rows.high - low)
                if self.layout == "leads" and self.leads is not None:
                    lead = b * kind.itemsize
                    raw = b"".join(source.read_at(lead, rows.start + (low + i) * row + k * lead) for i in range(n) for k in self.leads)
                    x = np.frombuffer(raw, kind).reshape(n, len(self.leads), b)
                else:
                    x = np.frombuffer(source.read_at(n * row, rows.start + low * row), kind).reshape(n, a, b)
                    x = x.transpose(0, 2, 1) if self.layout == "samples" else x
                    x = x if self.leads is None else x[:, self.leads]
                yield self.batch(rows.path, low, x.astype(np.float32))

    def batch(self, name: str, low: int, x: np.ndarray) -> pa.RecordBatch:
        n, leads, samples = x.shape
        ends = lambda count, size: pa.array(np.arange(count + 1, dtype=np.int32) * np.int32(size))
        inner = pa.ListArray.from_arrays(ends(n * leads, samples), pa.array(np.ascontiguousarray(x).ravel()))
        rate = pa.array(np.full(n, int(self.fs), np.int32)) if self.fs else pa.nulls(n, pa.int32())
        columns = [pa.array([name] * n), pa.array(np.arange(low, low + n)), pa.array(np.zeros(n, np.int32)), rate, pa.ListArray.from_arrays(ends(n, leads), inner)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "record_id", "seg_idx", "fs", "signal"])


class WaveArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waves"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader(dict(self.options))


def write_arrays(df: DataFrame, path: str | None = None, layout: str = "samples") -> str:
    """Write (signal) rows of one shape as (N, 1, T, C) or (N, 1, C, T) arrays, a file for each Arrow batch; returns the folder."""
    path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/arrays"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import uuid

        from ..operators.waves import Signals

        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        for b in batches:
            x = np.stack(Signals.of(b["signal"]).matrices()).astype(np.float32) if b.num_rows else np.zeros((0, 0, 0), np.float32)
            content = io.BytesIO()
            np.save(content, (x.transpose(0, 2, 1) if layout == "samples" else x)[:, None])
            with system.open_output_stream(name := f"{folder}/{uuid.uuid4().hex}.part") as out:
                out.write(content.getbuffer())
            system.move(name, name.replace(".part", ".npy"))  # a lost task leaves no half file to be read
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    df.select("signal").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return path
