"""Waveforms: rows (record_id, seg_idx, fs, signal) with signal as leads by samples.

What changes samples works on ``Signals``, the contiguous samples of an Arrow batch: no sample becomes a Python object, and a chain
such as ``prepare_windows`` is one pass over the batch. Leads of a record may differ in length. A null signal or lead stays null, an
empty lead empty, a null sample is not a number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import seeded
from .waves import Signals, at_rate, linear

#: Leads 0, 1 and 6 to 11 of twelve.
EIGHT = (0, 1, 6, 7, 8, 9, 10, 11)


def expand_segments(df: DataFrame, seg_idx: int | None = None, all_segments: bool = False) -> DataFrame:
    """One row per segment 0 .. seg_len - 1 (a missing count is 1 segment), or the one given segment, default 0."""
    count = F.greatest(F.coalesce(F.col("seg_len"), F.lit(1)), F.lit(1)).cast("int")
    if all_segments:
        return df.withColumn("seg_idx", F.explode(F.sequence(F.lit(0), count - 1)))
    return df.withColumn("seg_idx", F.lit(seg_idx or 0))


def to_lead_major(df: DataFrame, layout: str, col: str = "signal") -> DataFrame:
    """``samples``: (T, C) to leads by samples; ``leads``: kept. A first axis of length 1, as in (1, T, C), is left out."""
    if df.schema[col].dataType.simpleString().startswith("array<array<array<"):
        df = df.withColumn(col, F.get(col, F.lit(0)))
    if layout == "leads":
        return df
    lead = F.sequence(F.lit(1), F.size(F.col(col)[0]))
    turned = F.transform(lead, lambda i: F.transform(F.col(col), lambda sample: F.element_at(sample, i)))
    return df.withColumn(col, F.when((F.size(col) > 0) & (F.size(F.get(col, F.lit(0))) > 0), turned).otherwise(F.col(col)))


def _per_batch(df: DataFrame, change: Callable[[Signals, pa.RecordBatch], tuple[Signals, np.ndarray | None]], more: dict[str, str] | None = None) -> DataFrame:
    """``change`` over the signals of each Arrow batch. It gives the new signals and, where rows multiply, the row that each comes from;
    then a further column ``more`` counts the rows from the same one."""
    names, types = df.columns, dict(df.dtypes)
    added = list(more or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signals, source = change(Signals.of(b["signal"]), b)
            if source is not None:
                b = b.take(pa.array(source))
            columns = [signals.arrow() if c == "signal" else b[c] for c in names]
            if added:
                place = np.arange(len(source)) - np.searchsorted(source, source)
                columns.append(pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    kinds = [f"`{c}` {'array<array<double>>' if c == 'signal' else types[c]}" for c in names]
    return df.mapInArrow(run, ", ".join([*kinds, *(f"`{c}` {t}" for c, t in (more or {}).items())]))


def fourier_resample(df: DataFrame, target_fs: int) -> DataFrame:
    """Every lead at ``target_fs`` by the Fourier method; rows already at it are unchanged. A missing rate is 500."""
    resampled = _per_batch(df, lambda signals, b: (at_rate(signals, b["fs"], target_fs), None))
    return resampled.withColumn("fs", F.lit(target_fs).cast(dict(df.dtypes)["fs"]))


def linear_resample(df: DataFrame, m: int) -> DataFrame:
    """Every lead at ``m`` samples by linear interpolation."""
    return _per_batch(df, lambda signals, _: (signals.by_length(lambda x, _: linear(x, m)), None))


def adjust_length(df: DataFrame, length: int) -> DataFrame:
    """The first ``length`` samples, or zeros at the end."""
    return _per_batch(df, lambda signals, _: (signals.fitted(length), None))


def windowed(length: int, chunk: int | None) -> bool:
    return chunk is not None and 0 < chunk < length


def fixed_windows(df: DataFrame, length: int, chunk: int | None) -> DataFrame:
    """length // chunk windows side by side per row, the tail dropped; one whole window unless 0 < chunk < length."""
    if not windowed(length, chunk):
        return df.withColumn("chunk_idx", F.lit(0))
    return _per_batch(df, lambda signals, _: signals.windows(chunk, length // chunk), {"chunk_idx": "int"})


def random_window(df: DataFrame, length: int, chunk: int | None, epoch: int, seed: int, key: str = "record_id") -> DataFrame:
    """One window per row and epoch at an offset even in 0 .. length - chunk, by md5 of seed, epoch and key."""
    if not windowed(length, chunk):
        return df.withColumn("offset", F.lit(0))
    digest = seeded(seed, F.concat_ws(":", F.lit(epoch), F.col(key).cast("string")))
    offset = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % (length - chunk + 1)).cast("int")
    return _per_batch(df.withColumn("offset", offset), lambda signals, b: (signals.cut(np.asarray(b["offset"], np.int64), chunk), None))


def chunk_length(models: DataFrame, tasks: DataFrame) -> DataFrame:
    """model, task, chunk: window samples, round-half-even(chunk_seconds * target_fs); null unless below target_length."""
    grid = models.select("model", "chunk_seconds").crossJoin(tasks.select("task", "target_fs", "target_length"))
    chunk = F.rint(F.col("chunk_seconds") * F.col("target_fs")).cast("int")
    return grid.select("model", "task", F.when(chunk < F.col("target_length"), chunk).alias("chunk"))


def zscore(df: DataFrame, mean: list[float] | None, std: list[float] | None) -> DataFrame:
    """(x - mean) / (std + 1e-8) per lead, if both are given; one number per lead."""
    if mean is None or std is None:
        return df
    return _per_batch(df, lambda signals, _: (signals.scaled(mean, std), None))


def fill_nan(df: DataFrame) -> DataFrame:
    """NaN and null samples to 0."""
    return _per_batch(df, lambda signals, _: (signals.cleaned(), None))


def select_leads(df: DataFrame, idx: tuple[int, ...] = EIGHT, full: int = 12) -> DataFrame:
    """The leads ``idx`` where there are ``full`` of them, else all."""
    chosen = F.array(*[F.col("signal")[i] for i in idx])
    return df.withColumn("signal", F.when(F.size("signal") == full, chosen).otherwise(F.col("signal")))


def first_keys(df: DataFrame, limit: int, order: tuple[str, ...]) -> DataFrame:
    """_k0, _k1, ...: the order columns of the first rows, and no other column is read."""
    named = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)])
    return named.orderBy(*named.columns).limit(limit)


def lead_stats(df: DataFrame, limit: int = 5000, order: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """lead, mean, std over the first ``limit`` rows in order: the mean of the rows' means, and the root of the mean of their mean squares less its square.

    The limit is the statistic's definition. A first scan reads the order columns alone and finds the last key of the first
    rows. The wide scan keeps rows up to that key, a condition of literals that reaches the files. Where more rows have the last
    key than belong to the first, those of the least hashes of the signal count; rows of one hash are alike, so they count
    by their share. Only sums leave their tasks, no signals. A negative variance is null.
    """
    sums = lambda rows: rows.select("signal").mapInArrow(_lead_sums, "lead int, n double, m double, q double")
    first = first_keys(df, limit, order).collect()
    smaller, same = F.lit(False), F.lit(bool(first))
    for c, v in zip(order, first[-1] if first else ()):
        smaller = smaller | (same & (F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < F.lit(v))))  # nulls come first
        same = same & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    need = sum(r == first[-1] for r in first)
    if first and df.filter(same).select(*order).count() > need:
        hashed = df.filter(same).withColumn("_hash", F.xxhash64("signal"))
        least = [r[0] for r in hashed.select("_hash").orderBy("_hash").limit(need).collect()]
        alike = hashed.filter(F.col("_hash") == least[-1])
        share = least.count(least[-1]) / alike.select("_hash").count()
        found = sums(df.filter(smaller)).unionByName(sums(hashed.filter(F.col("_hash") < least[-1])))
        found = found.unionByName(sums(alike).select("lead", *[(F.col(c) * share).alias(c) for c in ("n", "m", "q")]))
    else:
        found = sums(df.filter(smaller | same))
    stats = found.groupBy("lead").agg((F.sum("m") / F.sum("n")).alias("mean"), (F.sum("q") / F.sum("n")).alias("q"))
    variance = F.col("q") - F.col("mean") * F.col("mean")
    return stats.select("lead", "mean", F.when(variance >= 0, F.sqrt(variance)).alias("std"))


def _lead_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each lead: the rows that have samples of it, and the sums of their means and mean squares, of all batches of a task."""
    total = np.zeros((3, 0))
    for b in batches:
        signals = Signals.of(b["signal"]).cleaned()
        full = signals.size > 0
        lead, size = signals.lead[full], signals.size[full]
        if not len(lead):
            continue
        if lead.max() >= total.shape[1]:
            total = np.pad(total, ((0, 0), (0, int(lead.max()) + 1 - total.shape[1])))
        begin = signals.begin[full]
        for row, x in enumerate((np.ones(len(lead)), np.add.reduceat(signals.x, begin) / size, np.add.reduceat(signals.x**2, begin) / size)):
            total[row] += np.bincount(lead, weights=x, minlength=total.shape[1])
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at]), pa.array(total[2, at])], names=["lead", "n", "m", "q"])


def prepare_windows(
    records: DataFrame, waves: DataFrame, labels: DataFrame, *, target_fs: int, length: int, chunk: int | None = None, mean: list[float] | None = None, std: list[float] | None = None, fold_col: str | None = None, folds: list[int] | None = None, n_labels: int | None = None
) -> DataFrame:
    """One row per window: record_id, seg_idx, chunk_idx, signal, labels.

    Records and labels meet first and without waveforms, after the fold filter; waveforms then join the narrow result,
    which Spark broadcasts where it is small. In their tasks, in one pass over each batch, they are resampled, fitted to length,
    cut, scaled, and last cleaned: what is not a number stays so until then, as scaling would move a zero. A record without
    labels gets ``n_labels`` zeros (by default as many as the longest list of labels has).
    """
    if fold_col is not None and folds is not None:
        records = records.filter(F.col(fold_col).isin(*folds))
    if n_labels is None:
        n_labels = labels.agg(F.max(F.size("labels"))).first()[0] or 0
    chosen = records.join(labels.select("record_id", "labels"), "record_id", "left")
    chosen = chosen.select("record_id", F.coalesce("labels", F.array_repeat(F.lit(0.0), n_labels).cast(labels.schema["labels"].dataType)).alias("labels"))
    rows = waves.join(chosen, "record_id").select("record_id", "seg_idx", "fs", "signal", "labels")

    def change(signals: Signals, b: pa.RecordBatch) -> tuple[Signals, np.ndarray]:
        signals = at_rate(signals, b["fs"], target_fs).fitted(length)
        signals, source = signals.windows(chunk, length // chunk) if windowed(length, chunk) else (signals, np.arange(b.num_rows))
        return (signals.scaled(mean, std) if mean is not None and std is not None else signals).cleaned(), source

    return _per_batch(rows, change, {"chunk_idx": "int"}).select("record_id", "seg_idx", "chunk_idx", "signal", "labels")
