"""Tables in the folder that all executors share: derived once, read by all that follow."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what reads it several times derives it once, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quarterdeck/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def once(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key, written when a session first asks for it; the inputs behind a key are taken not to change."""
    tables = spark.__dict__.setdefault("_quarterdeck_tables", {})
    known = tables.get((shared_root(spark), *key))
    if known is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(known.inputFiles()[0] if known.inputFiles() else shared_root(spark))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return known
    tables[(shared_root(spark), *key)] = table = kept(make(), key[0])
    return table
