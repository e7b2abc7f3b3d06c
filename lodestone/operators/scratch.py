"""Tables in the folder that driver and executors share: they cut lineages and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The name of a new folder under spark.checkpoint.dir. On one machine a local folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to such a folder and read it again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(df.settled_path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
