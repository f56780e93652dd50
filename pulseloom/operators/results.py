"""Tables of finished experiments, and cohort profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def best_epoch(df: DataFrame) -> DataFrame:
    """experiment, epoch, val_auroc_macro of the highest validation score, the earliest on ties; an undefined one never wins."""
    rows = df.filter(F.col("val_auroc_macro").isNotNull() & ~F.isnan("val_auroc_macro"))
    order = Window.partitionBy("experiment").orderBy(F.desc("val_auroc_macro"), "epoch")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("experiment", "epoch", "val_auroc_macro")


def summary_pivot(results: DataFrame, models: list[str]) -> DataFrame:
    """mode, task and one column per model of macro AUROC: the test value if there is a test row, even if undefined, else validation.

    ``results`` has model, task, mode, part (test or val) and auroc_macro.
    """
    best = results.groupBy("mode", "task", "model").agg(
        F.count_if(F.col("part") == "test").alias("tests"),
        F.max(F.when(F.col("part") == "test", F.col("auroc_macro"))).alias("test"),
        F.max(F.when(F.col("part") == "val", F.col("auroc_macro"))).alias("val"),
    )
    value = F.when(F.col("tests") > 0, F.col("test")).otherwise(F.col("val"))
    return best.withColumn("value", value).groupBy("mode", "task").pivot("model", models).agg(F.first("value"))


def age_profile(df: DataFrame, col: str = "age") -> DataFrame:
    """available, total, median, q25, q75 of ages, exact with linear interpolation; missing ages (null or NaN) left out."""
    value = F.col(col).cast("double")
    counts = df.agg(F.count_if(value.isNotNull() & ~F.isnan(value)).alias("available"), F.count(F.lit(1)).alias("total"))
    found = exact_quantiles(df, col, [0.5, 0.25, 0.75])
    return counts.select("available", "total", *[F.lit(v).cast("double").alias(c) for c, v in zip(("median", "q25", "q75"), found)])


def age_group_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """age_bin, n of rows with an ``age_bin``, bins without rows kept."""
    bins = df.sparkSession.createDataFrame([(n,) for n in names], "age_bin string")
    counts = df.filter("age_bin is not null").groupBy("age_bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "age_bin", "left").select("age_bin", F.coalesce("n", F.lit(0)).alias("n"))
