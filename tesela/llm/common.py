"""What the operators share: reading tables, cutting lineage, small type helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own = ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where that is unset on a single machine (tests) one of our own."""
    global _own
    if shared := spark.conf.get("spark.checkpoint.dir", ""):
        return shared
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _own = _own or tempfile.mkdtemp(prefix="tesela-")
    return f"file://{_own}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a table in the cluster's shared folder, so that lost executors lose nothing.

    A written table is read with column pruning and carries neither lineage nor the constraints of earlier plans,
    which iterative jobs would otherwise pile up.  The files go when the application ends, or with :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/tesela-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a checkpointed table that nothing will read again."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def utf8(name: str) -> Column:
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``: the fold a labelled row belongs to."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those whose key hashes lowest: the same rows on every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """doc_id, text (bytes) and label (0 or 1) of at most ``rows`` labelled documents; the ids are broadcast, bounded by that.

    An id labelled more than once takes its highest label, and of several texts of one id the first in byte order;
    rows without id or label take no part.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("label"))
    chosen = bounded_sample(chosen, "doc_id", rows).select(F.col("doc_id").alias("chosen_id"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    return found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")
