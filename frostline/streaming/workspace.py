"""Where queries keep checkpoints, intermediate tables and output when the caller gives no place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only a local master may go without it, as in tests; elsewhere a folder of one machine would lose rows silently.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: master {master} has executors on other machines")
    return tempfile.mkdtemp(prefix="frostline-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: no task that runs again can change its rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
