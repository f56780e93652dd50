"""Tables cut from their lineage and kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset: a temporary folder on one machine, an error on a cluster."""
    context = spark.sparkContext
    if (folder := spark.conf.get("spark.checkpoint.dir", None)) is None:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later plans start from the files, so a lost executor costs no recomputation and a value such as a partition
    number stays what it was. All tables of an application lie in one folder, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pulseloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
