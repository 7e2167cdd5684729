"""Tables that a job writes for itself in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where that is unset on a single machine (tests) one of our own."""
    global _own
    if shared := spark.conf.get("spark.checkpoint.dir", ""):
        return shared
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _own = _own or tempfile.mkdtemp(prefix="tesela-")
    return f"file://{_own}"


def place(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when the application ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table there."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, where a small table has fewer: before Python reads each row.

    Tables of many splits, as all large ones are, stay as they are and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into twice as many parts as there are cores: for narrow rows that cost much work each.

    Files say nothing of that work: a million numbers lie in one row group of a few bytes a row, which one task would read.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
