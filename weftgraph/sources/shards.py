"""Graph shards: tables partitioned by repository, replaced repository by repository, with snapshots by commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.work import remove, small, work_table

SCHEMA_VERSION = 1
#: Rows of one repository beyond which a shard is worth a warning.
LARGE = 50_000_000
#: Fixed value: folders of a table of many small repositories.
BUCKETS = 256


def write_shard(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the repositories that ``df`` holds and no others."""
    df.repartition("repo_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def _write_buckets(df: DataFrame, path: str) -> None:
    df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_buckets(df: DataFrame, path: str) -> None:
    """Replaces the rows of the repositories that ``df`` holds and no others, in a table whose folders (``bucket``) hold many repositories each, so that files do not grow with their number.
    A folder with such a repository is read and written again.  ``read_table``, ``forget`` and ``migrate`` take both kinds of tables; the others want a folder for each repository."""
    spark = df.sparkSession
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS)).cast("int"))
    if in_buckets(spark, path):
        at = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # no more than there are folders
        there = read_table(spark, path).where(F.col("bucket").isin(at))
        new = df.select(F.col("repo_id").alias("_new")).distinct()
        rows = work_table(rows.unionByName(there.join(new, there["repo_id"].eqNullSafe(new["_new"]), "left_anti")), "buckets")
    _write_buckets(rows, path)


def in_buckets(spark: SparkSession, path: str) -> bool:
    """Whether there is a table and its folders are buckets."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(p))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of shards; ids that look like numbers stay text, as they were written."""
    schema = spark.read.parquet(path).schema
    names = ("repo_id", "commit")
    return spark.read.schema(", ".join(f"`{f.name}` {'string' if f.name in names else f.dataType.simpleString()}" for f in schema)).parquet(path)


def large_shards(df: DataFrame, most: int = LARGE) -> DataFrame:
    """(repo_id, n) of the repositories whose shard is large."""
    return df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def _partition(spark: SparkSession, path: str, repo: str):
    """The folder of a repository's partition, its id escaped as Spark writes it."""
    return spark._jvm.org.apache.hadoop.fs.Path(path, "repo_id=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo))


class LazyShard:
    """A repository's shard that is looked at when it is made and read when it is used: ``changed`` tells whether its files are others than then."""

    def __init__(self, spark: SparkSession, path: str, repo: str):
        self._spark, self._path, self._repo = spark, path, repo
        self.identity = self._look()

    def _look(self) -> tuple:
        p = _partition(self._spark, self._path, self._repo)
        fs = p.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return ()
        return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(p)))

    def exists(self) -> bool:
        return bool(self.identity)

    def changed(self) -> bool:
        return self._look() != self.identity

    def rows(self) -> DataFrame:
        return read_shard(self._spark, self._path, self._repo)


def parser_versions(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, parser) by the smallest read there is: one column, of which the footers tell the extremes; repositories with several parsers have a row each."""
    return read_table(spark, path).groupBy("repo_id").agg(F.min("parser").alias("parser"), F.max("parser").alias("_m")).select("repo_id", F.explode(F.array_distinct(F.array("parser", "_m"))).alias("parser"))


def rebuild(spark: SparkSession, shard: str, target: str, repo: str) -> int:
    """Replaces a repository's partition of ``target`` by its shard; the rows written.  A repository without a shard is an error, and nothing is dropped for it."""
    rows = read_table(spark, shard).where(F.col("repo_id") == repo)
    n = rows.count()
    if not n:
        raise LookupError(f"{repo} has no shard")
    write_shard(rows, target)
    return n


def read_shard(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    out = read_table(spark, path)
    return out.where(F.col("repo_id") == repo) if repo else out


def archive(df: DataFrame, path: str, commit: str) -> None:
    """Keeps a snapshot of the repositories in ``df`` under a commit."""
    snap = df.withColumn("commit", F.lit(commit))
    snap.repartition("repo_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "commit").parquet(path)


def read_at(spark: SparkSession, path: str, repo: str, commit: str) -> DataFrame:
    """One snapshot; an unknown commit is an error, not an empty result."""
    out = read_table(spark, path).where((F.col("repo_id") == repo) & (F.col("commit") == commit))
    if out.isEmpty():
        raise LookupError(f"{repo} was not indexed at {commit}")
    return out


def read_as_of(spark: SparkSession, path: str, history: DataFrame, repo: str, at: str) -> DataFrame:
    """The last snapshot that was indexed at or before a time, by the history (repo_id, commit, indexed_at) of what was indexed when."""
    last = history.where((F.col("repo_id") == repo) & (F.col("indexed_at") <= F.lit(at).cast("timestamp"))).orderBy(F.desc("indexed_at"), F.desc("commit")).first()
    if last is None:
        raise LookupError(f"{repo} was not indexed before {at}")
    return read_at(spark, path, repo, last["commit"])


def snapshots_at(spark: SparkSession, path: str, history: DataFrame, at: str) -> DataFrame:
    """What ``read_as_of`` gives, for every repository at once: of each the last snapshot that was indexed at or before a time.  Repositories not indexed by then have no rows.  The chosen
    commits prune the folders that are read, as long as they are few enough to be broadcast."""
    then = history.where(F.col("indexed_at") <= F.lit(at).cast("timestamp"))
    last = then.groupBy("repo_id").agg(F.max(F.struct("indexed_at", "commit")).alias("m")).select("repo_id", "m.commit")
    return read_table(spark, path).join(F.broadcast(last) if small(last) else last, ["repo_id", "commit"])


def indexed_commits(spark: SparkSession, path: str, repo: str) -> DataFrame:
    return read_table(spark, path).where(F.col("repo_id") == repo).select("commit").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str = "node_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def partitions_of(repo: str) -> list[str]:
    """The partitions that hold a repository: its own, and those of its connectors and enrichments."""
    return [repo, f"@connect:{repo}", f"@enrich:{repo}"]


def forget(spark: SparkSession, paths: list[str], repo: str) -> None:
    """Drops a repository's partitions, also those of its connectors and enrichments, from every table."""
    for path in paths:
        if in_buckets(spark, path):
            rows = read_table(spark, path)
            own = F.coalesce(F.col("repo_id").isin(partitions_of(repo)), F.lit(False))
            at = [r["bucket"] for r in rows.where(own).select("bucket").distinct().collect()]
            left = work_table(rows.where(F.col("bucket").isin(at) & ~own), "buckets")
            _write_buckets(left, path)
            for b in set(at) - {r["bucket"] for r in left.select("bucket").distinct().collect()}:
                remove(spark, f"{path}/bucket={b}")
            continue
        for own in partitions_of(repo):
            p = _partition(spark, path, own)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def migrate(spark: SparkSession, path: str, old: str, new: str) -> int:
    """Moves a repository's partitions to a new id; the rows moved.  The new ones are written before the old ones go, so a failure loses nothing; a second run finds nothing to move."""
    rows = read_table(spark, path)
    own = rows.where(F.col("repo_id").isin(partitions_of(old)))
    n = own.count()
    if n:
        moved = own.withColumn("repo_id", F.replace("repo_id", F.lit(old), F.lit(new)))
        write_buckets(moved.drop("bucket"), path) if in_buckets(spark, path) else write_shard(moved, path)
        forget(spark, [path], old)
    return n
