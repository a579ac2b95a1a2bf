"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings for a local test or benchmark session. On a cluster the
# deployment supplies its own; nothing here is required by the operators.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "paxcast") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # One machine: its scratch folder is shared by all of the session's threads.
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paxcast-ckpt-"))
    builder = builder.config("spark.driver.memory", os.environ.get("PAXCAST_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; an error without one:
    a folder of the driver's own machine is no place for a cluster's files."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        raise ValueError("spark.checkpoint.dir names no folder; set it to one that driver and executors share")
    return current


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a new folder under ``spark.checkpoint.dir`` and read
    it back, for a table that several steps read: they read its files, not its inputs.
    A local session that names no folder gets a scratch folder of its one machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.conf.get("spark.master", "").startswith("local"):
        root = tempfile.mkdtemp(prefix="paxcast-ckpt-")
    else:
        root = checkpoint_dir(spark)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
