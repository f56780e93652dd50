"""Contiguous shards of equal bytes: prefix sums from bucket totals, cut at equal targets. DataFrame functions only.

Nulls: a null text has no bytes, a null id sorts first. Repeated rows are kept as rows. An empty table gives an
empty result. Only the id and text columns are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.shared import keep


def shard_by_bytes(docs: DataFrame, n_shards: int, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in the order of their ids, into ``n_shards`` runs of near equal bytes.

    A row's size is the UTF-8 length of its text plus ``overhead``. It goes to the shard in which the middle of its
    bytes lies, so a shard misses its target by at most half a document at either end. Returns id, size, text_crc32,
    shard, slot (place in the shard, from 0).

    Only (id, size, crc) move. They are range-partitioned once and written, each partition is a bucket, and bucket
    totals give the global byte and row offsets; no task sees more than a bucket. Rows equal in all of these may fill many buckets
    (a row number cuts them); any order of them is the same result.
    """
    spark = docs.sparkSession
    text = F.encode(F.col(text_col), "UTF-8")
    size = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")) + overhead
    narrow = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = keep(narrow.repartitionByRange(parts, *order, F.monotonically_increasing_id()).withColumn("bucket", F.spark_partition_id()))
    total = cut.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total"))
    placed = running_total(cut, {"start": "size", "place": F.lit(1).cast("long")}, "bucket", order)
    # the middle of the row in half bytes, times shards, over all half bytes; whole numbers throughout
    middle = (2 * F.col("start") + F.col("size")).cast("decimal(38,0)") * n_shards
    sharded = placed.crossJoin(F.broadcast(total)).select(
        *order, "place", F.floor(middle / (2 * F.col("total"))).cast("int").alias("shard")
    )
    first = sharded.groupBy("shard").agg(F.min("place").alias("first"))
    return sharded.join(F.broadcast(first), "shard").select(*order, "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(sharded: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, rows in slot order. Ids must be unique here."""
    placed = docs.join(sharded.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
