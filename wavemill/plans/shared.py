"""The folder that driver and executors share, for files and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, or below the session's checkpoint folder; only a local session may do
    without either, on a folder of the machine. The library doesn't delete it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm_dir.get() if jvm_dir.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="wavemill-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/wavemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written into the shared folder and read back: it is computed once, and lost executors lose nothing of it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
