"""Tables written on the way, in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the one that `spark.checkpoint.dir` names, deleted when the driver ends.

    Where that is unset, a local session uses its warehouse; on a cluster it is an error, as executors would write to their own disks.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/copse-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once and read back. The shuffle files that making it took go with the write, as nothing reads them again."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
