"""Joins of records with labels, paths, metadata and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_dataset(df: DataFrame, dataset: str | None = None, leads: int | None = None) -> DataFrame:
    """Rows of one dataset, with ``lead`` as given, that have a path."""
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    if leads is not None:
        df = df.filter(F.col("lead") == leads)
    return df.filter(F.col("filepath").isNotNull()) if "filepath" in df.columns else df


def filter_folds(df: DataFrame, fold_col: str, ids: list[int]) -> DataFrame:
    """Rows whose fold is in the list."""
    return df.filter(F.col(fold_col).isin(*ids))


def join_labels(records: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """All records with their labels; a label column named like a record column gets the suffix _label."""
    clash = {c: f"{c}_label" for c in labels.columns if c != key and c in records.columns}
    return records.join(labels.withColumnsRenamed(clash), key, "left")


def lookup_paths(df: DataFrame, names: DataFrame, key: str = "record_name", order: str = "pos") -> DataFrame:
    """Rows with a stored path; of repeated names the last in ``order`` counts."""
    last = names.groupBy(key).agg(F.max_by("filepath", order).alias("filepath"))
    return df.join(last.filter("filepath is not null"), key)


def join_metadata(sample: DataFrame, table: DataFrame, key: str = "filepath") -> DataFrame:
    """Sampled keys with their record metadata."""
    return sample.join(table, key)


def attach_folds(records: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Each record's patient fold, -1 where there is none; a column ``fold`` that the records have is replaced."""
    if key != "fold":
        records = records.drop("fold")
    return records.join(folds.select(key, "fold"), key, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def pending_experiments(models: DataFrame, tasks: DataFrame, modes: DataFrame, done: DataFrame) -> DataFrame:
    """The grid of model, task and mode without the experiments that have test metrics. The grid is small by nature."""
    grid = models.select("model").crossJoin(tasks.select("task")).crossJoin(modes.select("mode"))
    return grid.join(done.select("model", "task", "mode").distinct(), ["model", "task", "mode"], "left_anti")


def match_report(df: DataFrame, cond: Column) -> DataFrame:
    """matched, total, rate (null for no rows)."""
    matched, total = F.count_if(cond), F.count(F.lit(1))
    return df.agg(matched.alias("matched"), total.alias("total"), (matched / F.nullif(total, F.lit(0))).alias("rate"))


def union_predictions(*dfs: DataFrame, id_col: str = "ecg_id") -> DataFrame:
    """Prediction parts of many workers end to end, without the padding rows (negative ids)."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out.filter(F.col(id_col) >= 0)


def check_counts(meta: DataFrame, waves: DataFrame, split: str = "split") -> DataFrame:
    """Splits whose metadata rows and waveform rows differ in number."""
    a = meta.groupBy(split).agg(F.count(F.lit(1)).alias("n_meta"))
    b = waves.groupBy(split).agg(F.count(F.lit(1)).alias("n_waves"))
    both = a.join(b, split, "full_outer").select(split, F.coalesce("n_meta", F.lit(0)).alias("n_meta"), F.coalesce("n_waves", F.lit(0)).alias("n_waves"))
    return both.filter("n_meta <> n_waves")


def check_leads(df: DataFrame, n: int, col: str = "signal") -> DataFrame:
    """Records whose signal hasn't ``n`` leads."""
    return df.select("record_id", F.size(col).alias("n_leads")).filter(F.col("n_leads") != n)


def check_alignment(a: DataFrame, b: DataFrame, key: str, flag: str = "flag") -> DataFrame:
    """n_a, n_b, only_a, only_b, differ: whether two row sets pair up in key and flag."""
    both = a.select(key, F.col(flag).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, F.col(flag).alias("_b"), F.lit(True).alias("_in_b")), key, "full_outer")
    in_a, in_b = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()
    return both.agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(in_b & ~in_a).alias("only_b"),
        F.count_if(in_a & in_b & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differ"),
    )
