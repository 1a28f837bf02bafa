"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract here: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bounds of one Arrow batch handed to Python, so that a worker's memory
#: doesn't follow the partition's size.
BATCH_ROWS = 1024
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (read when a plan is executed)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and an executor's memory holds them all."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """``run`` (an iterator of batches to one) that releases memory at its end."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a folder of its own only in local mode without one, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders by the scratch() they were made in; the first list is for those outside of any.
_scopes: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession):
    """Folders made inside are deleted at the end, but for those made ``outer``; shuffles that nothing refers to any more go with them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        gc.collect()
        spark._jvm.System.gc()


def temporary(spark: SparkSession, label: str, outer: bool = False) -> str:
    """A new folder in the shared folder; it is deleted at the end of its scratch(), or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    _scopes[-2 if outer and len(_scopes) > 1 else -1].append(path)
    return path


def materialize(df: DataFrame, label: str, codec: str = "zstd", outer: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing. ``outer``: see scratch()."""
    path = f"{temporary(df.sparkSession, label, outer)}/table"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def tucked(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with the columns ``used`` as they are and all others in one struct, where no name an operator makes can clash with theirs.

    Also gives a function of a frame and the names of result columns, which
    brings the columns of ``docs`` back in their order, but for those that
    results replace, and the results after them.
    """
    rest = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []))

    def out(df: DataFrame, *made: str) -> DataFrame:
        new = {m.lower() for m in made}
        old = [F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns if c.lower() not in new]
        return df.select(*old, *made)

    return packed, out
