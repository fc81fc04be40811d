"""Shared folders, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary folder only where that is unset and driver
    and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to or comes from a Python worker.
BATCH = 8 << 20


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Queries that run here delete their shuffle files when they end, as what they write is not computed from them
    again, and hand Python workers batches of bounded size."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, tag)
    with frugal(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def bucketed(df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``keys``: later joins on them move only the other side."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    name = "quillspark_" + path.rsplit("-", 1)[1]
    with frugal(spark):
        df.write.bucketBy(shuffle_partitions(spark), *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._written_path, out._table = path, name
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``bucketed`` that nothing reads any more."""
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
    removed(*tables)


def removed(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._written_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) only, so extra columns of the input cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


@cache
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library has no such call
        return None


def freed() -> None:
    """Give memory that a task of this worker no longer uses back to the system: workers are reused, and several wait
    beside those that run."""
    pa.default_memory_pool().release_unused()
    if trim := _libc():
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 950_000) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``most`` bytes of ``column`` (one row at least), so memory follows bytes, not rows."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        part = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)
        del b
    freed()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
