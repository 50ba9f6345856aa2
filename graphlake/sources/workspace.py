"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


TASK_ROWS = 2_000_000  # of a shuffle, in one task


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a session on
    one machine gets a fresh temporary folder; on a cluster, whose executors would
    each write to a disk of their own, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def ship_package(spark: SparkSession) -> None:
    """Give the workers of a cluster this package, once a session, by way of the
    shared folder; a worker started later, on any machine, gets it too. On one
    machine, or without a shared folder, workers import what the session's Python
    path holds."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.master.split("[")[0] == "local" or not spark.conf.get("spark.checkpoint.dir", None):
        sc.environment.setdefault("PYTHONPATH", str(package.parent))
        return
    name = f"{package.name}-{sc.applicationId}.zip"
    if name in sc._python_includes:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*")):
            if f.is_file() and f.suffix != ".pyc":
                z.write(f, f.relative_to(package.parent))
    at, files = _filesystem(spark, f"{shared_dir(spark)}/{name}")
    out = files.create(at, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(at.toString())


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again, and its path:
    the lineage ends there, so a lost executor repeats nothing that lies before."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    return stored(df, what, compression)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing will read again."""
    for path in paths:
        at, files = _filesystem(spark, path)
        files.delete(at, True)


def materialised(df: DataFrame) -> DataFrame:
    """A round of an iterative operator, stored."""
    return written(df, "round")


@contextmanager
def roomy(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, shuffles have at least the partitions that so many rows need, so a
    task's memory does not grow with the table."""
    key = "spark.sql.shuffle.partitions"
    had = spark.conf.get(key)
    spark.conf.set(key, str(max(int(had), -(-rows // TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(key, had)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker, which lives on, gives
    the memory it no longer uses back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
