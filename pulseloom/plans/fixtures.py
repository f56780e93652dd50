"""The driver's tables seen as recordings, codes, waveforms and predictions, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, pid, codes: an order's part keys as text, by line number and part."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("pid"))
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    codes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.transform(entries, lambda x: x["l_partkey"].cast("string")).alias("codes"))
    return orders.join(codes, "record_id", "left").withColumn("codes", F.coalesce("codes", F.lit([]).cast("array<string>")))


def named(spark: SparkSession, sf_dir: str, column: str = "p_brand") -> DataFrame:
    """record_id, pid, names: the parts' brands in the order of the codes."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), column), "l_partkey")
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", column)))
    names = lines.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.transform(entries, lambda x: x[column]).alias("names"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("pid"))
    return orders.join(names, "record_id", "left").withColumn("names", F.coalesce("names", F.lit([]).cast("array<string>")))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, pid, encoded: each brand's number as its label index."""
    number = F.transform("names", lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))
    return named(spark, sf_dir).select("record_id", "pid", number.alias("encoded"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, seg_idx, fs, signal: embeddings as 4 leads of 16 samples at rate 16."""
    lead = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, F.lit(16)), lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.lit(0).alias("seg_idx"), F.lit(16).alias("fs"), lead.alias("signal"))


def event_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id (user), lead (event type), x: values in order of time; of uneven length."""
    entries = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record_id"), F.col("event_type").alias("lead"))
    return events.agg(F.transform(entries, lambda e: e["value"]).alias("x"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, seg_idx, fs, signal: one lead per event type that the user has, in order of its name; rate 8."""
    leads = F.transform(F.array_sort(F.collect_list(F.struct("lead", "x"))), lambda e: e["x"])
    return event_waves(spark, sf_dir).groupBy("record_id").agg(leads.alias("signal")).select("record_id", F.lit(0).alias("seg_idx"), F.lit(8).alias("fs"), "signal")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ecg_id, class_idx, target, score: quality and toxicity labels with the documents' tied scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 97) / 97).alias("s"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    one = lambda i, c: rows.select(F.col("doc_id").alias("ecg_id"), F.lit(i).alias("class_idx"), F.col(c).alias("target"), F.col("s").alias("score"))
    return one(0, "quality").unionByName(one(1, "toxic"))


def digest(df: DataFrame, *keys: str) -> DataFrame:
    """keys, lead, n, total: a signal's leads by length and place-weighted sum."""
    rows = df.select(*keys, F.posexplode("signal").alias("lead", "x"))
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select(*keys, "lead", F.size("x").alias("n"), F.round(weighted, 5).alias("total"))


LISTS = """lists AS (
  SELECT o_orderkey AS record_id, o_custkey AS pid, coalesce(codes, []) AS codes FROM orders LEFT JOIN (
    SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS codes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def named_sql(column: str = "p_brand") -> str:
    return f"""named AS (
  SELECT o_orderkey AS record_id, o_custkey AS pid, coalesce(names, []) AS names FROM orders LEFT JOIN (
    SELECT l_orderkey, list({column} ORDER BY l_linenumber, l_partkey) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
  ON l_orderkey = o_orderkey)"""


ENTRIES = """entries AS (
  SELECT l_orderkey AS record_id, o_custkey AS pid, regexp_extract(p_brand, '(\\d+)', 1)::INTEGER AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)"""
WAVES = """waves AS (
  SELECT vec_id AS record_id, list_transform(range(0, 4), lambda i: list_transform(embedding[i * 16 + 1 : i * 16 + 16], lambda x: x::DOUBLE)) AS signal
  FROM embeddings)"""
EVENT_WAVES = """event_waves AS (
  SELECT user_id AS record_id, event_type AS lead, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY 1, 2)"""
PREDICTIONS = """preds AS (
  SELECT doc_id AS ecg_id, 0 AS class_idx, quality AS target, (n_chars % 97) / 97.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 1, toxic, (n_chars % 97) / 97.0::DOUBLE FROM labels JOIN documents USING (doc_id))"""
WEIGHTED = "round(coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i)), 0), 5)"


def digest_sql(source: str, *keys: str) -> str:
    """The SQL of ``digest`` over a relation with ``signal``."""
    k = ", ".join(keys)
    return f"""SELECT {k}, lead, len(x)::INTEGER AS n, {WEIGHTED} AS total FROM (
  SELECT {k}, lead, signal[lead + 1] AS x FROM (SELECT *, unnest(range(0, len(signal)))::INTEGER AS lead FROM {source}))"""
