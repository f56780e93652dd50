"""Label-stratified folds by record and by patient, splits and samples. Seeded by md5, whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import keep
from .dealing import deal, evened, joined

#: Units that one task deals out; the driver gets about three kilobytes for each block (ten folds, forty labels).
BLOCK = 16_384


def seeded(seed: int, col: str | Column) -> Column:
    """md5 of ``seed:value``, the same text in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string") if isinstance(col, str) else col.cast("string")))


def _stratified(units: DataFrame, key: str, n_folds: int, seed: int, block: int) -> DataFrame:
    """key, fold of units (key, labels with repeats, weight)."""
    rows = units.select(key, F.coalesce("labels", F.lit([]).cast("array<int>")).alias("labels"), F.col("weight").cast("long").alias("weight"), F.coalesce(seeded(seed, key), F.lit("0" * 32)).alias("_md5"))
    rows = keep(rows)
    classes = np.array(sorted(r[0] for r in rows.select(F.explode("labels")).distinct().collect() if r[0] is not None), np.int64)
    blocks = max(1, -(-rows.count() // block))
    own = F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") * blocks / 2**32).cast("int")
    kind = rows.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_md5", "ascending"), (key, "ascending")]).combine_chunks()
        lists, weight = t["labels"].combine_chunks(), np.asarray(t["weight"], np.int64)
        size, flat = np.asarray(lists.value_lengths(), np.int64), lists.flatten()
        unit = np.repeat(np.arange(len(size)), size)[np.asarray(flat.is_valid())]
        pair, times = np.unique(unit * max(1, len(classes)) + np.searchsorted(classes, np.asarray(flat.drop_null(), np.int64)), return_counts=True)
        unit, label = pair // max(1, len(classes)), pair % max(1, len(classes))
        ends = np.append(0, np.cumsum(np.bincount(unit, minlength=len(size)))).astype(np.int64)
        part = deal(ends, label, times, weight, n_folds, len(classes))
        part = evened(part, ends, label, times, weight, n_folds, len(classes))
        tally = np.zeros((n_folds, len(classes) + 1), np.int64)
        np.add.at(tally, (part[unit], label), times)
        tally[:, -1] = np.bincount(part, weights=weight, minlength=n_folds)
        n = len(size)
        sums = pa.array([None] * n + [tally.tobytes()], pa.binary())
        number = pa.array(np.full(n + 1, pc.min(t["_block"]).as_py(), np.int32))
        keys = pa.concat_arrays([t[key].combine_chunks(), pa.nulls(1, t.schema.field(key).type)])
        return pa.table([keys, number, pa.array(np.append(part, -1).astype(np.int32)), sums], names=[key, "_block", "_part", "_tally"])

    placed = keep(rows.withColumn("_block", own).groupBy("_block").applyInArrow(run, f"`{key}` {kind}, _block int, _part int, _tally binary"))
    sums = {r["_block"]: np.frombuffer(r["_tally"], np.int64).reshape(n_folds, -1) for r in placed.filter("_part < 0").select("_block", "_tally").collect()}
    numbers = sorted(sums)
    fold = joined(np.array([sums[b] for b in numbers], float).reshape(len(numbers), n_folds, len(classes) + 1)) if numbers else np.zeros((0, n_folds), int)
    spark = units.sparkSession
    found = [(b, p, int(fold[i, p])) for i, b in enumerate(numbers) for p in range(n_folds)]
    names = F.broadcast(spark.createDataFrame(found, "_block int, _part int, fold int"))
    return placed.filter("_part >= 0").join(names, ["_block", "_part"]).select(key, "fold")


def stratify_records(df: DataFrame, n_folds: int, seed: int = 0, key: str = "record_id", labels: str = "encoded", block: int = BLOCK) -> DataFrame:
    """key, fold: folds of equal size in which every label is spread evenly, by iterative stratification.

    Records are dealt by the md5 of their keys in blocks of about ``block``, each in one task, and the blocks' parts are matched so that
    fold sizes differ by at most one and what is uneven in the blocks cancels out.
    """
    rows = df.select(key, F.array_distinct(labels).alias("labels"), F.lit(1).alias("weight"))
    return _stratified(rows, key, n_folds, seed, block)


def patient_labels(df: DataFrame, key: str = "pid", labels: str = "encoded") -> DataFrame:
    """key, labels (all records' label indexes, repeats kept, ascending), n_records."""
    return df.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(labels))).alias("labels"), F.count(F.lit(1)).alias("n_records"))


def stratify_patients(df: DataFrame, n_folds: int, seed: int = 0, key: str = "pid", labels: str = "encoded", block: int = BLOCK) -> DataFrame:
    """key, fold: as ``stratify_records`` for patients, who fill a fold by their records and count for a label as often as their records have it.

    A label counts once a record. All records of a patient share a fold; patients with most records are dealt first.
    """
    once = df.withColumn(labels, F.array_distinct(labels))
    patients = patient_labels(once, key, labels)
    return _stratified(patients.select(key, "labels", F.col("n_records").alias("weight")), key, n_folds, seed, block)


def original_folds(records: DataFrame, names: DataFrame, folds: DataFrame, n_folds: int = 10, labels: str = "encoded") -> DataFrame:
    """record_id, fold: provided folds over record -> name -> fold, -1 where missing.

    If the smallest fold is 1 all are shifted to start at 0; a -1 anywhere suppresses the shift. With under half of the
    records matched, the folds are ``stratify_records`` instead. Needs ``labels`` only then.
    """
    found = records.join(names.select("record_id", "name"), "record_id", "left").join(folds.select("name", F.col("fold").alias("_given")), "name", "left")
    found = found.withColumn("fold", F.coalesce("_given", F.lit(-1)))
    facts = found.agg(F.count_if(F.col("fold") >= 0).alias("hit"), F.count(F.lit(1)).alias("n"), F.min("fold").alias("low")).first()
    if facts["n"] and 2 * facts["hit"] < facts["n"]:
        return stratify_records(records, n_folds, labels=labels)
    return found.select("record_id", (F.col("fold") - (1 if facts["low"] == 1 else 0)).cast("int").alias("fold"))


def fold_summary(df: DataFrame, fold_col: str = "fold") -> DataFrame:
    """fold, n, and the sizes of train (below max - 1, unassigned included), val (max - 1) and test (max) on every row."""
    per = df.groupBy(F.col(fold_col).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max("fold").over(Window.partitionBy())
    kind = F.when(F.col("fold") == F.col("_top"), "test").when(F.col("fold") == F.col("_top") - 1, "val").otherwise("train")
    rows = per.withColumn("_top", top).withColumn("_kind", kind)
    size = lambda k: F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("n"))).over(Window.partitionBy()), F.lit(0))
    return rows.select("fold", "n", *[size(k).alias(f"{k}_size") for k in ("train", "val", "test")])


def auto_split(df: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Add split: train for folds 0 to max - 2, val max - 1, test max; an unassigned row belongs to none."""
    top = df.agg(F.max(fold_col).alias("_top"))
    fold = F.col(fold_col)
    split = F.when(fold < 0, None).when(fold == F.col("_top"), "test").when(fold == F.col("_top") - 1, "val").when(fold < F.col("_top") - 1, "train")
    return df.crossJoin(F.broadcast(top)).withColumn("split", split).drop("_top")


def balanced_sample(df: DataFrame, a: str, b: str, n: int, seed: int, key: str = "filepath") -> DataFrame:
    """key, flag: as many rows with a and not b (flag 1) as with b and not a (flag 0), at most ``n`` of each, drawn by md5.

    Rows are not ranked: counts by the digests' first digits, then by the next ones of the digits at the cut, find the digest up to which
    a flag's rows are taken. That is a filter, whatever ``n`` is. Rows without a key take no part; of rows that share the last key
    as many are taken as are wanted.
    """
    is_a, is_b = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    rows = df.select(key, F.when(is_a & ~is_b, 1).when(is_b & ~is_a, 0).alias("flag"), seeded(seed, key).alias("_md5")).filter("flag is not null and _md5 is not null")
    sizes = {r["flag"]: r["n"] for r in rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = min(n, sizes.get(0, 0), sizes.get(1, 0))
    if take <= 0:
        return rows.limit(0).select(key, "flag")
    # of each flag: the digits so far of the last digest, and how many of the rows that begin so are wanted
    cut, open_ = {f: ("", take) for f in (0, 1)}, {0, 1}
    while open_:
        at = F.lit(False)
        for f in open_:
            at = at | ((F.col("flag") == f) & F.col("_md5").startswith(cut[f][0]))
        size = F.length(F.when(F.col("flag") == 1, F.lit(cut[1][0])).otherwise(F.lit(cut[0][0])))
        digits = F.substr("_md5", F.lit(1), size + 4)
        counts = rows.filter(at).groupBy("flag", digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).orderBy("flag", "digits").collect()
        for f in sorted(open_):
            want = cut[f][1]
            for r in (r for r in counts if r["flag"] == f):
                if want <= r["n"]:
                    break
                want -= r["n"]
            cut[f] = (r["digits"], want)
            if want == r["n"] or len(r["digits"]) >= 32:
                open_.discard(f)
    below, last, parts = F.lit(False), F.lit(False), []
    for f, (digits, want) in cut.items():
        own = F.col("flag") == f
        below, last = below | (own & (F.col("_md5") < digits)), last | (own & F.col("_md5").startswith(digits))
        if len(digits) >= 32:  # rows of one key are alike
            parts.append(rows.filter(own & (F.col("_md5") == digits)).distinct().select(key, "flag", F.explode(F.sequence(F.lit(1), F.lit(want))).alias("_nth")).drop("_nth"))
            last = last & ~(own & (F.col("_md5") == digits))
    out = rows.filter(below | last).select(key, "flag")
    for p in parts:
        out = out.unionByName(p)
    return out
