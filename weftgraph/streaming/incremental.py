"""Incremental indexing as a stream: new shards are merged repository by repository, unchanged heads are skipped.

The event-time window at the end is an extension: the graph engine itself has no event-time operators.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..plans.work import work_table
from ..sources.shards import read_table, write_buckets


def needs_reindex(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows of ``current`` (repo_id, head, parser) whose head or parser differs from what is indexed."""
    old = indexed.select("repo_id", F.col("head").alias("_h"), F.col("parser").alias("_p"), F.lit(True).alias("_known"))
    rows = current.join(old, "repo_id", "left")
    same = F.col("_known") & F.col("head").eqNullSafe(F.col("_h")) & F.col("parser").eqNullSafe(F.col("_p"))
    return rows.where(~F.coalesce(same, F.lit(False))).select(*current.columns)


#: What a query with timers needs: a store that has them, and no batches without rows, of which there would be no end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _none(x):
    return None if x is None or x is pd.NaT or x != x else x


def decide(old: tuple | None, new: tuple) -> str:
    """What a shard (head, parser, seq) is to a repository whose last one is ``old``: "new" replaces it, "more" goes on with it, "known" and "late" ones are left out.  Nulls are values; a null seq is the smallest."""
    rank = lambda seq: (seq is not None, seq or 0)
    if old is None:
        return "new"
    if old[:2] == new[:2]:
        return "more" if old[2] == new[2] else "known"
    return "late" if rank(new[2]) < rank(old[2]) else "new"


class Shards(StatefulProcessor):
    """Keeps the last shard of each repository: its head, parser and seq, and the rows that came.  Rows that may belong to it are passed on as they stream past, then one row with the decision;
    ``patience`` seconds after the last rows a timer tells that nothing more came."""

    def __init__(self, columns: list[str], patience: int):
        self._columns, self._patience = columns, patience

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "head string, parser string, seq long, n long")

    def handleInputRows(self, key, rows, timerValues):
        old = self._last.get() if self._last.exists() else None
        known = (_none(old[0]), _none(old[1]), _none(old[2])) if old else None
        best, counts = None, {}
        rank = lambda k: tuple((v is not None, v or ("" if i else 0)) for i, v in enumerate((k[2], k[0], k[1])))
        for pdf in rows:
            pdf = pdf.set_axis(self._columns, axis=1)  # computed columns come without their names
            shard = [(_none(h), _none(p), None if _none(s) is None else int(s)) for h, p, s in zip(pdf["head"], pdf["parser"], pdf["seq"])]
            for k in shard:
                counts[k] = counts.get(k, 0) + 1
            best = max([*counts], key=rank)
            # A shard that is behind one seen already cannot be the repository's last.
            ahead = pdf[[rank(k) >= rank(best) for k in shard]]
            if len(ahead):
                yield ahead.assign(_what="row", _n=None)[[*self._columns, "_what", "_n"]]
        what = decide(known, best)
        n = counts[best] + (old[3] if what == "more" else 0)
        if what in ("new", "more"):
            self._last.update((*best, n))
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self._patience)
        yield self._said(key, best, what, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        head, parser, seq, n = self._last.get()
        yield self._said(key, (_none(head), _none(parser), _none(seq)), "settled", n)

    def _said(self, key, shard: tuple, what: str, n: int) -> pd.DataFrame:
        own = {"repo_id": key[0], "head": shard[0], "parser": shard[1], "seq": shard[2]}
        return pd.DataFrame({**{c: pd.Series([own.get(c)], dtype=object) for c in self._columns}, "_what": [what], "_n": [n]})

    def close(self) -> None:
        pass


def index_stream(spark: SparkSession, incoming: str, schema: str, target: str, state: str, checkpoint: str, patience: int = 3600) -> StreamingQuery:
    """Follows ``incoming`` (rows with repo_id, head, parser, seq and payload); each batch replaces the repositories in ``target`` whose head is new.

    What a repository's last shard is lies in the state of ``Shards``, keyed by repository; ``state`` is the table of it (head, parser, seq, n, status: open, or settled once nothing has come for ``patience``
    seconds).  A shard may arrive in several batches: rows of the head and parser that a repository already has, with the same ``seq``, are added to what is there; the same head with
    a later ``seq`` is a shard that was indexed before and is skipped.  Equal rows of one file are rows of their own; equal rows of several files are the same ones come again, so a batch
    that is run twice, or a file sent twice, leaves the same.  Null heads, parsers and seqs are values.  Both tables lie in buckets of many repositories (``shards.write_buckets``).
    """
    payload = spark.createDataFrame([], schema)
    columns = payload.columns
    shard = ["repo_id", "head", "parser", "seq"]

    def merge(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        batch = work_table(batch, "shard-rows")
        said = batch.where("_what <> 'row'").select(*shard, "_what", "_n")
        taken = said.where(F.col("_what").isin("new", "more"))
        if said.isEmpty():
            return
        met = functools.reduce(lambda a, c: a & batch[c].eqNullSafe(taken[c]), shard, F.lit(True))
        fresh = batch.where("_what = 'row'").join(taken.select(*shard), met, "left_semi").select(*columns, "_nth")
        more = taken.where("_what = 'more'").select("repo_id")
        if not more.isEmpty():
            # A repository is replaced as a whole, so what it holds goes along; it is read before it is written over.
            there = read_table(session, target).join(more, "repo_id", "left_semi").select(*columns)
            nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
            fresh = fresh.unionByName(there.withColumn("_nth", nth))
        rows = work_table(fresh.dropDuplicates([*columns, "_nth"]).drop("_nth"), "merged")
        if not rows.isEmpty():
            write_buckets(rows, target)
        told = said.where(F.col("_what").isin("new", "more", "settled")).groupBy("repo_id").agg(F.max_by(F.struct("head", "parser", "seq", "_n", "_what"), F.when(F.col("_what") == "settled", 1).otherwise(0)).alias("s"))
        if not told.isEmpty():
            status = F.when(F.col("s._what") == "settled", "settled").otherwise("open")
            write_buckets(told.select("repo_id", "s.head", "s.parser", "s.seq", F.col("s._n").alias("n"), status.alias("status")), state)

    source = spark.readStream.schema(schema).parquet(incoming).select("*", F.col("_metadata.file_path").alias("_file"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*payload.schema, *source.schema.fields[-1:]])
    kept = [*columns, "_file"]
    out = source.groupBy("repo_id").transformWithStateInPandas(Shards(kept, patience), f"{kinds}, _what string, _n long", "Append", "ProcessingTime")

    def number(batch: DataFrame, i: int) -> None:
        """Numbers equal rows of a file, so that they stay apart where rows are made distinct."""
        nth = F.row_number().over(Window.partitionBy("_file", *columns).orderBy(F.lit(0)))
        merge(batch.withColumn("_nth", nth).drop("_file"), i)

    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)  # the query keeps its own copy of the session's settings
    try:
        return out.writeStream.foreachBatch(number).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events of each kind in tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")
