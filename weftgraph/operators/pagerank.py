"""Personalized PageRank of many queries by forward push: estimates and residuals are rows, pushed along edges by joins.

A query starts with its residual on the seeds.  A push moves ``1 - damping`` of a node's residual to its estimate and spreads the rest over its edges; all nodes
whose residual is above ``tolerance`` times their number of edges push at once.  When none is left, an estimate is too small by at most the sum of
the query's residuals, which ``push`` returns with it.  Nodes without edges give back to the seeds.  The edges of a hub lie under several
salts, so that no task holds all of them (where few enough to be counted and broadcast, they are); each round's sums are taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import small, work_table

#: Edges of a node that lie under one salt.
HUB = 50_000
#: Rounds that are planned at once; then the state is written, so that plans stay short and lost executors cost little.
PLANNED = 5


def shares(seeds: DataFrame) -> DataFrame:
    """(query_id, node_id, share): a seed's part of its query's positive scores; equal parts where none is positive."""
    one = seeds.groupBy("query_id", F.col("id").alias("node_id")).agg(F.max(F.greatest("score", F.lit(0.0))).alias("s"))
    total = one.groupBy("query_id").agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("n"))
    return one.join(total, "query_id").select("query_id", "node_id", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(1 / F.col("n")).alias("share"))


def push(pairs: DataFrame, seeds: DataFrame, damping: float = 0.5, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """(query_id, node_id, score, residual) over each query's undirected ``pairs`` (query_id, src, dst), from ``seeds`` (query_id, id, score); residual is what the query's nodes still hold together."""
    start = work_table(shares(seeds), "shares")
    both = pairs.select("query_id", "src", "dst").union(pairs.select("query_id", "dst", "src")).distinct()
    degree = both.groupBy("query_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    nodes = start.join(degree, ["query_id", "node_id"], "full").select("query_id", "node_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("r"))
    nodes = nodes.withColumn("salts", F.greatest(F.ceil(F.col("n") / HUB), F.lit(1)).cast("int"))
    state = work_table(nodes.select("query_id", "node_id", "n", "salts", F.lit(0.0).alias("p"), "r"), "push")
    out = both.join(state.select("query_id", F.col("node_id").alias("src"), "n", "salts"), ["query_id", "src"])
    edges = out.select("query_id", F.col("src").alias("node_id"), F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst", (1 / F.col("n")).alias("w"))
    back = state.where("n = 0").select("query_id", "node_id").join(start.select("query_id", F.col("node_id").alias("dst"), F.col("share").alias("w")), "query_id")
    edges = work_table(edges.unionByName(back.withColumn("salt", F.lit(0)), allowMissingColumns=False), "push-edges")
    edges = F.broadcast(edges) if small(edges) else edges
    active = F.col("r") > F.greatest(F.col("n"), F.lit(1)) * tolerance
    for _ in range(-(-most // PLANNED)):
        if state.where(active).isEmpty():
            break
        for _ in range(PLANNED):
            # A node's own row has the salt -1 and meets no edge; what it sends has the salts of its edges.  So the state is read once.
            rows = state.withColumn("moved", F.when(active, F.col("r")).otherwise(0.0)).withColumn("salt", F.explode(F.when(active, F.sequence(F.lit(-1), F.col("salts") - 1)).otherwise(F.array(F.lit(-1)))))
            met, own = rows.join(edges, ["query_id", "node_id", "salt"], "left"), F.col("salt") < 0
            kept = lambda x: F.when(own, x).otherwise(F.lit(0))
            r = F.when(own, F.col("r") - F.col("moved")).otherwise(F.coalesce(F.col("moved") * damping * F.col("w"), F.lit(0.0)))
            next_ = met.select("query_id", F.coalesce("dst", "node_id").alias("node_id"), kept(F.col("n")).alias("n"), kept(F.col("salts")).alias("salts"), kept(F.col("p") + F.col("moved") * (1 - damping)).cast("double").alias("p"), r.alias("r"))
            state = next_.groupBy("query_id", "node_id").agg(F.max("n").alias("n"), F.max("salts").alias("salts"), F.sum("p").alias("p"), F.sum("r").alias("r"))
        state = work_table(state, "push")
    left = state.groupBy("query_id").agg(F.sum("r").alias("residual"))
    return state.join(left, "query_id").select("query_id", "node_id", F.col("p").alias("score"), "residual")
