"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are stored as blocks: runs of ``block`` vectors in vec_id order with a forward index (the vectors) and, for each
component ("term"), its largest and smallest value.  A query's bound for a block sums, over terms, the larger
of its product with both.  Blocks are taken by falling bound and scored through their forward index until the
next bound lies below the k-th score, so no hit can be missed; a bound equal to it is still scored, since a smaller
vec_id wins ties.

Queries and candidates meet in a grid of bounded cells (``query_cell`` queries by ``cell`` candidates), each one
task's work; the k-th score of a query in the first cell is its floor in the others, and the k best of each cell are merged by a window for each query.  Rows whose vector is null or holds a null or non-finite
component take no part; neither do null ids, nor vectors with a component of 2**62 / scale (2**54) or more in size, whose floor(scale * x) a
64-bit integer need not hold.  Vectors of different dimension are not compared.  Rows that
repeat an id are candidates of their own (a query's own id is left out altogether); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Components beyond this size are multiplied as Python integers, as 64-bit sums could wrap.
_SAFE = 1 << 27


def quantize(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and q: each component x as floor(scale * x), for rows whose vector is whole and finite, with components below 2**62 / scale in size."""
    x = F.col(vector).cast("array<double>")
    limit = F.lit(float(1 << 62) / scale)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit)) & (F.size(x) > 0)
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("q")
    )


def _matrix(values: list) -> np.ndarray:
    m = np.array(values, dtype=np.int64)
    return m if not m.size or np.abs(m).max() < _SAFE else m.astype(object)


def _float_safe(m: np.ndarray, q: np.ndarray) -> bool:
    """Whether inner products are exact in double precision (then BLAS may do them)."""
    return m.dtype != object and q.dtype != object and float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * m.shape[1] < 2**52


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int, floors: np.ndarray | None = None, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the k best for each query, by score and smaller id; those below a query's floor (a score that k candidates elsewhere are known
    to reach) may be left out.  ``scored`` gets the number of blocks scored and of all blocks, over all queries."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    fast = _float_safe(vectors, queries)
    kind = np.float64 if fast else object
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    out_q, out_v, out_s = [], [], []
    met = 0
    for i, q in enumerate(queries):
        if i % 256 == 0:
            part = queries[i : i + 256]
            bounds = np.where(part > 0, part, 0) @ top.T + np.where(part < 0, part, 0) @ low.T
        bound = bounds[i % 256]
        best_s, best_v = np.zeros(0, kind), np.zeros(0, np.int64)
        by_bound = np.argsort(-bound, kind="stable")
        at, wave = 0, 2
        floor = None if floors is None or floors[i] is None else int(floors[i])
        while at < len(by_bound):
            least = best_s[k - 1] if len(best_s) >= k else None
            if floor is not None and (least is None or least < floor):
                least = floor
            if least is not None and bound[by_bound[at]] < least:
                break
            own = by_bound[at : at + wave]
            at, wave = at + len(own), wave * 2
            if least is not None:
                own = own[bound[own] >= least]
            met += len(own)
            rows = (starts[own][:, None] + np.arange(block)).ravel()
            rows = rows[rows < len(ids)]
            rows = rows[ids[rows] != query_ids[i]]
            s, v = np.append(best_s, vectors[rows] @ q), np.append(best_v, ids[rows])
            keep = np.lexsort((v, -s))[:k]
            best_s, best_v = s[keep], v[keep]
        out_q.append(np.full(len(best_v), query_ids[i]))
        out_v.append(best_v)
        out_s.append(best_s)
    if scored is not None:
        scored += [met, len(starts) * len(queries)]
    joined = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return joined(out_q, np.int64), joined(out_v, np.int64), joined(out_s, np.int64)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], k: int, block: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query in each cell; ``right`` has a floor for each query."""

    def cell_hits(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        floors = np.array([int(x) if some else None for x, some in zip(b["floor"], b["has_floor"])], dtype=object)
        hits = search(a["vec_id"].to_numpy(np.int64), _matrix(list(a["q"])), b["vec_id"].to_numpy(np.int64), _matrix(list(b["q"])), k, block, floors)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), hits)))

    # Without nulls the floors stay integers; a column with nulls would reach pandas as doubles, which round beyond 2**53.
    right = right.withColumn("has_floor", F.col("floor").isNotNull()).withColumn("floor", F.coalesce("floor", F.lit(0)))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell_hits, "query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 64, cell: int | None = None, query_cell: int = 1 << 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates other than itself.

    Both tables have vec_id and q (see ``quantize``).  Cells hold 65,536 rows each, fewer candidates where that would
    leave cores idle; query rows that repeat id and vector count once, candidates that do up to k times.  Cells are ranges of
    candidates in (vec_id, hash of the vector) order, so blocks are ranges too; where there are several, queries meet the first one alone, and
    the k-th score found there is their floor in the others.
    """
    spark = candidates.sparkSession
    # No more than k of rows that are alike in all can be among the k best.
    alike = candidates.groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("n")).select("vec_id", "q", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("i"))
    alike = shared.table(alike, "vectors")
    queries = shared.table(queries.select("vec_id", "q").distinct(), "queries")
    n, m = alike.count(), queries.count()
    cell = cell or max(4096, min(1 << 16, -(-n // 24)))
    cells, query_cells = max(1, -(-n // cell)), max(1, -(-m // query_cell))
    ranged = alike.repartitionByRange(cells, "vec_id", F.xxhash64("q"), "i").withColumn("c", F.spark_partition_id())
    # Written: a cell's rows stay the same whatever is run again.
    left = shared.table(ranged.select("vec_id", "q", "c", F.size("q").alias("d")), "cells")
    cells = (left.agg(F.max("c")).first()[0] or 0) + 1  # as many ranges as there are, which may be others than were asked for
    asked = queries.withColumn("g", F.pmod(F.xxhash64("vec_id", "q"), F.lit(query_cells)).cast("int")).withColumn("d", F.size("q"))
    floors = queries.select("vec_id", "q", F.lit(None).cast("long").alias("floor"))
    if cells > 1:
        lead = left.agg(F.min("c")).first()[0]
        first = left.where(F.col("c") == lead).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))))
        found = _meet(first, asked.withColumn("floor", F.lit(None).cast("long")), ["g", "d"], k, block)
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "floor")
        # An id with several vectors has several queries under one id: their lists cannot be told apart, so they get no floor.
        once = queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("vec_id")
        floors = shared.table(queries.join(once.join(kth, "vec_id"), "vec_id", "left").select("vec_id", "q", "floor"), "floors")
    right = asked.join(floors, ["vec_id", "q"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))))
    hits = _meet(left, right, ["c", "g", "d"], k, block)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
