"""Shared plumbing: the work folder that all executors see, tables that cut lineage, batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset and the master is local (tests) a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work table or folder through Hadoop, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            if spark._jsc.sc().isStopped():
                continue
            remove(spark, path)
        except Exception:  # the session is gone
            return


#: Spark deletes an execution's shuffle files at its end; safe where the result is a table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages survive lost executors without
    recomputing it, and the shuffle files behind it are freed at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a work table that nothing reads any more."""
    if path := getattr(df, "_weft_path", None):
        remove(df.sparkSession, path)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; anything else a table carries is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What a worker process keeps from task to task, by the operator that needs it.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    return _kept.setdefault(owner, {})


def release(owner: str | None = None) -> None:
    """Frees what other operators have left in this worker process, which Spark uses again for any stage."""
    left = [k for k, v in _kept.items() if k != owner and v]
    for k in left:
        _kept[k].clear()
    if left:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # not this C library
            pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds about ``most`` bytes of ``column``; one row may hold more.  What operators other than ``owner`` keep in the worker is freed first."""
    release(owner)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
