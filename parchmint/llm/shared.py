"""What the operators of this subpackage share: the shared work folder, written tables, Arrow kernels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where the session names none, a temporary folder if driver
    and executors are one process, as in tests; on a cluster a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        alone = re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master)
        named = tempfile.mkdtemp(prefix="parchmint-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/parchmint-work"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone by then; the folder's owner cleans what is left
            pass

    atexit.register(drop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written once in the shared folder: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The kernel whose cache this Python worker holds, and how to empty it.
_HELD: list = [None, None]


def free_memory() -> None:
    """Gives freed memory back to the system, where the libraries can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hold_cache(owner: str, clear: Callable[[], None]) -> None:
    """A worker outlives its stage; the cache of one kernel goes when another kernel begins, so caches don't add up."""
    if _HELD[0] != owner:
        if _HELD[1] is not None:
            _HELD[1]()
            free_memory()
        _HELD[:] = [owner, clear]


#: Bytes of rows that Spark hands to a Python kernel at a time, where the session keeps Spark's own default of 64 MB.
BATCH_BYTES = "2m"


def narrow_batches(spark: SparkSession) -> None:
    """Long texts come in batches by bytes: both sides of the pipe hold a batch, and in growing buffers up to twice."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        with contextlib.suppress(Exception):  # a Spark without this setting
            spark.conf.set(name, BATCH_BYTES)


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, rows: int = 2000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes of a text column, or one row of more, so that
    few texts at a time stand in memory as Python strings."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = max(at + 1, min(at + rows, full))
            yield batch.slice(at, to - at)
            at = to
    free_memory()  # the worker may wait long for its next task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as one of ``columns`` is called so (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0.

    Counts the places where a word begins: every character that isn't white space and follows white space or nothing.
    """
    return F.regexp_count(text_or_empty(column), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")).cast("long")
