"""Snapshots of processed tables (S6, S7): one partition per processing time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "snapshot_ts"


def write_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Append ``df`` to the table at ``path`` as the snapshot ``stamp`` (a
    sortable text such as 20240131_235959)."""
    df.withColumn(STAMP, F.lit(stamp)).write.mode("append").partitionBy(STAMP).parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot. Its name is read from the partition folders, and
    the filter on it prunes every other one."""
    table = spark.read.option("recursiveFileLookup", "false").parquet(path)
    table = table.withColumn(STAMP, F.col(STAMP).cast("string"))
    newest = table.agg(F.max(STAMP)).first()[0]
    return table.where(F.col(STAMP) == newest).drop(STAMP)
