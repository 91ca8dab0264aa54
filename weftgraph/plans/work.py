"""Work tables in the folder that the driver and all executors share: they cut lineage, survive lost executors and go at the session's end."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_named: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must be set for several processes")
        where = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, name in _named:
        try:
            if not spark._jsc.sc().isStopped():
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session is gone
            break
    for spark, path in _made:
        try:
            if not spark._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # the session is gone
            return


#: Rows of a join's or an aggregate's input that one task is given; folders that one task writes at a time before it sorts its rows.
_ROWS, _FOLDERS = 1_000_000, 64


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks ``rows`` are dealt to, so that what one task holds does not grow with the tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _ROWS))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a write, put back behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def work_table(df: DataFrame, name: str, by: str | None = None, tasks: int | None = None) -> DataFrame:
    """Writes ``df`` once, in folders by the column ``by`` if named, and reads it back.  Shuffles have at least ``tasks`` partitions; rows are not sorted by the folder that they go to."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    own = {"spark.sql.shuffle.partitions": str(tasks)} if tasks else {}
    with settings(spark, own | ({"spark.sql.maxConcurrentOutputFileWriters": str(_FOLDERS)} if by else {})):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed_table(df: DataFrame, name: str, by: str, tasks: int, dealt: bool = False) -> DataFrame:
    """Writes ``df`` once, one file for each of ``tasks`` buckets of the column ``by``, and reads it back: joins and groups by that column read it without a shuffle.  ``dealt``: it was repartitioned so."""
    spark, name = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _made.append((spark, path))
    _named.append((spark, name))
    (df if dealt else df.repartition(tasks, by)).write.bucketBy(tasks, by).option("path", path).saveAsTable(name)
    return spark.table(name)


def small(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether a broadcast of ``df`` is bounded: it stops counting behind ``rows``."""
    return df.limit(rows + 1).count() <= rows
