"""Shared helpers of the training-data operators: scratch tables, folds, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a vectorised kernel takes at once, which bounds a Python worker's memory.
PIECE_BYTES = 4 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quarterdeck/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; lost executors can't take it along."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.quarterdeck_path = path
    return table


def store_of(uri: str):
    """A file system of pyarrow and the path in it, for a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), uri)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing unfinished reads, and let Spark drop the shuffle files of finished steps now,
    not when the driver next collects its garbage."""
    for table in tables:
        store, path = store_of(table.quarterdeck_path)
        store.delete_dir(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(hashes: DataFrame, bits: int) -> np.ndarray:
    """The slots (leading bits) of a column h of 64-bit hashes as a bit table of a fixed 2**bits bits.

    It spares rows that are surely not wanted a shuffle; it never loses one.
    """
    slot = F.shiftrightunsigned("h", 64 - bits) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_slots(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h.view(np.uint64) >> np.uint64(64 - bits)
    return table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0


def only_slots(df: DataFrame, hashes: DataFrame, bits: int = 24, *, once: bool = False) -> DataFrame:
    """Rows of df whose column h may be in the column h of hashes, without h; df's h must be its last column.

    once: of rows equal in the first column a task passes on the first.
    """
    table = df.sparkSession.sparkContext.broadcast(slots(hashes, bits))
    schema = T.StructType(df.schema.fields[:-1])

    def run(batches):
        seen: set = set()
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            keep = in_slots(table.value, h, bits)
            for k in np.flatnonzero(keep) if once else ():
                key = batch.column(0)[k].as_py()
                keep[k] = key not in seen
                seen.add(key)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return df.mapInArrow(settled(run), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(folds)


def one_label(labels_df: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): the larger of repeated labels; rows without an id or a label give none."""
    return (
        labels_df.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def label_sample(labels_df: DataFrame, column: str, folds: int, held: int, fit_rows: int) -> DataFrame:
    """(doc_id, label) outside the held fold: at most about fit_rows, which a hash of the id picks, so it may be broadcast."""
    known = written(one_label(labels_df, column).where(fold("doc_id", folds) != held), "labels")
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    return known


def settled(run):
    """A mapInArrow function that gives freed memory back after a longer run: a Python worker lives on for other stages."""

    def inner(batches):
        began = time.monotonic()
        yield from run(batches)
        if time.monotonic() - began > 0.2:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return inner


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """(first row, end row) of runs of rows of about limit bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), in place where it can."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
