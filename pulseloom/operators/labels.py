"""From code lists to label tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.scalars import truthy
from ..functions.shared import keep


#: A mapping of at most so many entries and bytes is broadcast and looked up inside the rows.
LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 32 << 20


def replaced(df: DataFrame, col: str, mapping: DataFrame, by: str, values: list[str], most: int = LOOKUP_ROWS) -> DataFrame:
    """Replace the entries of the array ``col`` by the mapping's values, order and repeats kept, unmapped ones dropped.

    Adds one array per value column, named in the plural; a null array gives empty ones. Of a key that the mapping holds more than
    once the least values count. A mapping whose size is checked to be small goes to the executors and is looked up in
    the row, so no row moves. A larger one meets the exploded (row, place, entry) in a join whose kind Spark picks; the row
    is a number of our own, so records may share a key or lack one.
    """
    unique = mapping.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("_entry")).agg(F.min(F.struct(*values)).alias("_v")).select("_entry", "_v.*")
    found = unique.limit(most + 1).toArrow()
    if found.num_rows <= most and found.nbytes <= LOOKUP_BYTES:
        return _looked_up(df, col, found, {v: unique.schema[v].dataType.simpleString() for v in values})
    return _joined(df, col, unique, values)


def _looked_up(df: DataFrame, col: str, mapping: pa.Table, kinds: dict[str, str]) -> DataFrame:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, mapping.schema) as writer:
        writer.write_table(mapping)
    sent = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    held: list[pa.Table] = []  # in a worker: the table of this function, read once

    def look(lists: pa.Array) -> pa.Array:
        if not held:
            held.append(pa.ipc.open_stream(sent.value).read_all().combine_chunks())
        table = held[0]
        size = np.asarray(pc.fill_null(lists.value_lengths(), 0), np.int64)
        at = pc.index_in(lists.flatten(), value_set=table["_entry"])
        ends = np.append(0, np.cumsum(np.asarray(at.is_valid()))) if len(at) else np.zeros(1, np.int64)
        offsets = pa.array(ends[np.append(0, np.cumsum(size))].astype(np.int32))
        hits = at.drop_null()
        parts = [pa.ListArray.from_arrays(offsets, pc.take(table[v], hits).combine_chunks()) for v in kinds]
        return pa.StructArray.from_arrays(parts, names=list(kinds))

    found = F.arrow_udf(look, ", ".join(f"`{v}` array<{t}>" for v, t in kinds.items()))
    rows = df.withColumn("_hits", found(F.col(col)))
    return rows.withColumns({f"{v}s": F.col(f"_hits.{v}") for v in kinds}).drop("_hits")


def _joined(df: DataFrame, col: str, mapping: DataFrame, values: list[str]) -> DataFrame:
    rows = keep(df.withColumn("_row", F.monotonically_increasing_id()))
    hit = rows.select("_row", F.posexplode(col).alias("_place", "_entry")).join(mapping, "_entry")
    gathered = hit.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_place", *values))).alias("_hits"))
    types = dict(mapping.dtypes)
    out = rows.join(gathered, "_row", "left")
    return out.withColumns({f"{v}s": F.coalesce(F.col(f"_hits.{v}"), F.lit([]).cast(f"array<{types[v]}>")) for v in values}).drop("_row", "_hits")


def unique_mapping(mapping: DataFrame, on_dup: str, order: str = "pos") -> DataFrame:
    """code, name: trimmed, without entries that lack a code; of a repeated code the first or the last in ``order``."""
    pick = F.min_by if on_dup == "first" else F.max_by
    rows = mapping.select(F.trim("code").alias("code"), F.trim("name").alias("name"), order).filter("code is not null and code <> ''")
    return rows.groupBy("code").agg(pick("name", order).alias("name"))


def map_codes(df: DataFrame, mapping: DataFrame, on_dup: str, col: str = "codes", most: int = LOOKUP_ROWS) -> DataFrame:
    """Add names: each code's name in order, repeats kept, unmapped codes dropped; a record with none keeps an empty list."""
    return replaced(df, col, unique_mapping(mapping, on_dup), "code", ["name"], most)


def mapping_override(mapping: DataFrame, extra: DataFrame) -> DataFrame:
    """Entries of ``extra`` replace or add to the mapping."""
    return mapping.join(extra, "code", "left_anti").unionByName(extra)


def explode_mapping(df: DataFrame, key: str, val: str, order: str = "pos") -> DataFrame:
    """code, name from a mapping whose key cell holds codes split by ``;``; the last wins; N/A, nan and empty keys are skipped."""
    cells = df.select(F.explode(F.split(key, ";")).alias("code"), F.trim(val).alias("name"), order)
    cells = cells.withColumn("code", F.trim("code")).filter(~F.col("code").isin("", "N/A", "nan"))
    return cells.groupBy("code").agg(F.max_by("name", order).alias("name"))


def code_subsets(df: DataFrame, statements: DataFrame, flag: str, col: str = "codes", most: int = LOOKUP_ROWS) -> DataFrame:
    """The codes whose statement has ``flag`` above 0; a code without the flag leaves the list, the record stays."""
    flagged = statements.filter(F.col(flag) > 0).select(F.col("code"), F.col("code").alias("kept"))
    return replaced(df, col, flagged, "code", ["kept"], most).withColumn(col, F.col("kepts")).drop("kepts")


def class_rollup(df: DataFrame, statements: DataFrame, level: str, col: str = "codes", most: int = LOOKUP_ROWS) -> DataFrame:
    """Add names: each code's class at ``level``; codes without one dropped, repeats kept."""
    classes = statements.filter(F.col(level).isNotNull()).select("code", F.col(level).alias("name"))
    return replaced(df, col, classes, "code", ["name"], most)


def label_counts(df: DataFrame, col: str = "names") -> DataFrame:
    """label, n: occurrences over all lists; a label twice in a record counts twice."""
    return df.select(F.explode(col).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def first_seen(df: DataFrame, col: str = "names", order: str = "record_id") -> DataFrame:
    """label, n and where it is first seen (record in order, then place), for the frequency order."""
    entries = df.select(order, F.posexplode(col).alias("place", "label"))
    return entries.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "place")).alias("seen"))


def label_vocab(counts: DataFrame, min_cnt: int = 10, order: str = "name") -> DataFrame:
    """label_idx, label, n of labels seen at least ``min_cnt`` times: by name, or by count with ties by first seen.

    The vocabulary is cut into ranges of that order and written once; places are running totals over these, so one of any
    size is many tasks' work.
    """
    by = ["label"] if order == "name" else [F.desc("n"), "seen" if "seen" in counts.columns else "label"]
    kept = keep(counts.filter(F.col("n") >= min_cnt).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    return running_total(kept, {"label_idx": F.lit(1).cast("long")}, "_range", by).select(F.col("label_idx").cast("int"), "label", "n")


def filter_encode_labels(df: DataFrame, vocab: DataFrame, col: str = "names", most: int = LOOKUP_ROWS) -> DataFrame:
    """Add filtered (labels of the vocabulary) and encoded (their indexes); order and repeats kept, may be empty."""
    kept = vocab.select("label", F.col("label").alias("filtered"), F.col("label_idx").alias("encoded"))
    out = replaced(df, col, kept, "label", ["filtered", "encoded"], most)
    return out.withColumnsRenamed({"filtereds": "filtered", "encodeds": "encoded"})


def multi_hot(df: DataFrame, labels: list[tuple[str, str]], col: str = "names", key: str = "record_id") -> DataFrame:
    """key and one boolean column per (label, column name), in one projection; all-false records stay."""
    return df.select(key, *[F.coalesce(F.array_contains(col, label), F.lit(False)).alias(name) for label, name in labels])


def superclass_any(df: DataFrame, groups: dict[str, list[str]], normal: str | None = None, key: str = "record_id") -> DataFrame:
    """key and one boolean per class: any of its member columns that exist is true. ``normal`` needs its own member and none of the others'."""
    def any_of(members: list[str]) -> Column:
        present = [truthy(F.col(m)) > 0 for m in members if m in df.columns]
        return reduce(lambda a, b: a | b, present) if present else F.lit(False)

    own = {name: any_of(members) for name, members in groups.items()}
    if normal in own:
        others = [c for name, c in own.items() if name != normal]
        own[normal] = own[normal] & ~reduce(lambda a, b: a | b, others, F.lit(False))
    return df.select(key, *[c.alias(name) for name, c in own.items()])


def label_partition(df: DataFrame, lists: dict[str, list[str]], key: str = "record_id") -> dict[str, DataFrame]:
    """The label columns of a wide table by list, in the list's order, and what no list names as ``rest``."""
    named = {c for names in lists.values() for c in names}
    parts = {name: [c for c in names if c in df.columns] for name, names in lists.items()}
    parts["rest"] = [c for c in df.columns if c != key and c not in named]
    return {name: df.select(key, *columns) for name, columns in parts.items()}


def label_matrix(df: DataFrame, label_cols: list[str] | None = None, key: str = "record_id") -> DataFrame:
    """key and labels, the label columns as doubles in order; all but the key if none are given; null and NaN are 0."""
    chosen = label_cols or [c for c in df.columns if c != key]

    def number(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        value = F.col(c).cast("double") if kind not in ("boolean", "string") else truthy(F.col(c))
        return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))

    return df.select(key, F.array(*[number(c) for c in chosen]).alias("labels"))
