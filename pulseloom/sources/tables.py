"""Tables in and out: delimited records, header texts, waveforms, label tables, dictionaries, metrics and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import sanitize_label
from .arrays import WaveArrays

#: One row per finished experiment.
RESULTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("timestamp", "model", "task", "eval_mode", "save_dir")]
    + [T.StructField(c, T.IntegerType()) for c in ("num_classes", "train_size", "val_size", "test_size", "best_epoch")]
    + [T.StructField(c, T.DoubleType()) for c in ("best_val_auroc", "test_auroc_macro", "test_auroc_micro", "test_auprc_macro", "test_f1_macro", "val_auroc_macro")]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, lower: bool = False) -> DataFrame:
    """A CSV table with a header; names in lower case if asked, only the given columns if any. No schema: all strings."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    if lower:
        df = df.toDF(*[c.lower() for c in df.columns])
    return df.select(*columns) if columns else df


def read_header_codes(spark: SparkSession, path: str, name: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """record_name, codes: the whole numbers, as text, of the first line that starts with ``dx:`` (in any case); empty without one.

    Header lines may begin with ``#``; what is no whole number between the commas is left out, leading zeros too. The
    record's name is what ``name`` finds in the path, else the file's name.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    line = F.regexp_extract("value", r"(?im)^#?[ \t]*dx:[ \t]*([^\r\n]*)", 1)
    whole = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[+-]?[0-9]{1,38}$"))
    codes = F.transform(whole, lambda x: x.cast("decimal(38,0)").cast("string"))
    return text.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("record_name"), codes.alias("codes"))


def read_waveforms(spark: SparkSession, path: str, layout: str | None = None, fs: int | None = None, leads: tuple[int, ...] | None = None) -> DataFrame:
    """record_id, seg_idx, fs, signal (leads by samples).

    From Parquet; with a ``layout`` ("samples" or "leads", the order of the last two axes) from .npy arrays, whose rows are the records and
    which are read by ranges of rows (see ``sources.arrays``): then record_id is the row's number in its ``file``, one more column.
    """
    if layout is None:
        return spark.read.parquet(path).select("record_id", "seg_idx", "fs", "signal")
    spark.dataSource.register(WaveArrays)
    reader = spark.read.format("waves").option("layout", layout)
    if fs is not None:
        reader = reader.option("fs", str(fs))
    if leads is not None:
        reader = reader.option("leads", ",".join(map(str, leads)))
    return reader.load(path)


def label_columns(vocab: DataFrame, rule: str = "paper") -> list[tuple[str, str]]:
    """(label, column name) in order of label_idx; the vocabulary is small by construction. Of labels that share a name the last stays."""
    rows = vocab.select("label_idx", "label", sanitize_label(F.col("label"), rule).alias("column_name")).orderBy("label_idx").collect()
    return [(label, name) for name, label in {r["column_name"]: r["label"] for r in rows}.items()]


def write_labels(df: DataFrame, path: str) -> None:
    """A multi-hot label table (key and one true/false column per label) as CSV with a header."""
    df.write.option("header", True).csv(path)


def write_label_dictionary(vocab: DataFrame, dataset: str, path: str, rule: str = "paper") -> None:
    """One JSON object {dataset, n_labels, labels: column -> name}."""
    names = vocab.select("label_idx", "label", sanitize_label(F.col("label"), rule).alias("column"))
    names = names.groupBy("column").agg(F.max_by("label", "label_idx").alias("label"), F.max("label_idx").alias("label_idx"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("label_idx", "column", "label"))), lambda x: F.struct(x["column"], x["label"]))
    row = names.agg(F.lit(dataset).alias("dataset"), F.count(F.lit(1)).alias("n_labels"), F.map_from_entries(entries).alias("labels"))
    row.coalesce(1).write.json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(metric, value) as ``key: value`` lines in order of the keys."""
    line = F.concat_ws(": ", "metric", F.coalesce(F.col("value").cast("string"), F.lit("nan")))
    metrics.orderBy("metric").select(line.alias("value")).coalesce(1).write.text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of lines that split at the first ``:`` and whose value is a number."""
    lines = spark.read.text(path)
    key, value = F.regexp_extract("value", r"^([^:]*):(.*)$", 1), F.regexp_extract("value", r"^([^:]*):(.*)$", 2)
    return lines.select(F.trim(key).alias("metric"), F.trim(value).try_cast("double").alias("value")).filter("value is not null")


#: What names a run of an experiment.
RUN = ("timestamp", "model", "task", "eval_mode", "save_dir")


def append_results(df: DataFrame, path: str) -> None:
    """Add experiments to the growing results table; missing metrics are NaN, a missing best epoch is -1.

    Each run (its ``RUN`` columns) is a partition of the table, and a write replaces the partitions it has rows for and no others. So a
    job that is repeated, as a whole or after a failure, leaves its rows once, and jobs of other runs may write meanwhile.
    """
    empty = {T.DoubleType(): F.lit(float("nan")), T.IntegerType(): F.lit(-1)}
    columns = []
    for field in RESULTS:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        default = empty.get(field.dataType) if field.name == "best_epoch" or field.dataType == T.DoubleType() else None
        columns.append((F.coalesce(value, default) if default is not None else value).alias(field.name))
    run = F.concat(F.lit("run-"), F.md5(F.to_json(F.struct(*RUN), {"ignoreNullFields": "false"})))
    rows = df.select(*columns).withColumn("run", run).repartition("run")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results table, one row per run."""
    return spark.read.schema(RESULTS).parquet(path).select(*RESULTS.names)
