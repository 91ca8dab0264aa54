"""Breadth-first traversals as frontier joins; every hop is a bounded shuffle and its result a work table in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.view import confidence_rank
from ..plans.work import bucketed_table, small, work_table

#: The relations that carry an impact, how far it is followed, and how many hits are kept.
IMPACT = ["calls", "depends_on", "inherits", "references", "reads", "writes", "uses"]
HOPS, HITS = 3, 100


def _surest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the edges (at, next, ...) of a pair the surest: by confidence, relation and line."""
    edge = F.struct(confidence_rank(F.col("confidence")).alias("r"), "relation", "line", "confidence")
    return rows.groupBy(*keys).agg(F.min(edge).alias("e"))


def blast_radius(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, relations: list[str] | None = None, limit: int | None = HITS, nodes: DataFrame | None = None) -> DataFrame:
    """What reaches a seed backwards: (seed, node_id, hop, via, confidence, relation, line, truncated).  The first reach wins: fewest hops, surest edge, smallest
    via (the node reached before); relation and line are those of its edge, the place to look at.  Of a seed the first ``limit`` by hop, confidence and id stay, and
    truncated says whether there were more.  With ``nodes``, ends that are no node are neither hits nor followed.

    The first hop reads only edges into the seeds; the adjacency is written once a second hop needs it, so that further hops read it and not the view behind it.
    """
    line = F.col("source_line") if "source_line" in edges.columns else F.lit(None).cast("int")
    back = edges.where(F.col("relation").isin(relations or IMPACT)).select(F.col("dst").alias("at"), F.col("src").alias("next"), "confidence", "relation", line.alias("line"))
    known = nodes.select(F.col("node_id").alias("next")).distinct() if nodes is not None else None
    frontier = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("at")).distinct()
    seen = frontier.select("seed", F.col("at").alias("node_id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("int").alias("line"))
    stored = None
    for hop in range(1, hops + 1):
        if hop == 1:
            own = _surest(back.join(frontier, "at"), ["seed", "at", "next"])
        else:
            if stored is None:
                stored = work_table(_surest(back, ["at", "next"]), "adjacency")
            own = frontier.join(stored, "at")
        if known is not None:
            own = own.join(known, "next", "left_semi")
        reach = own.groupBy("seed", F.col("next").alias("node_id")).agg(F.min(F.struct("e.r", F.col("at").alias("via"), "e.confidence", "e.relation", "e.line")).alias("w"))
        first = reach.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        new = work_table(first.select("seed", "node_id", F.lit(hop).alias("hop"), "w.via", "w.confidence", "w.relation", "w.line"), "frontier")
        seen, frontier = seen.unionByName(new), new.select("seed", F.col("node_id").alias("at"))
        if new.isEmpty():
            break
    hits = seen.where("hop > 0")
    if limit is None:
        return hits.withColumn("truncated", F.lit(False))
    totals = hits.groupBy("seed").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    order = Window.partitionBy("seed").orderBy("hop", confidence_rank(F.col("confidence")), "node_id")
    return hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r").join(totals, "seed")


def impact_index(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, limit: int | None = None) -> DataFrame:
    """(seed, n_hits, n_direct, n_sure, furthest) of many seeds in one traversal."""
    hits = blast_radius(edges, seeds, hops, limit=limit)
    return hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n_hits"), F.sum((F.col("hop") == 1).cast("long")).alias("n_direct"), F.sum((F.col("confidence") == "EXTRACTED").cast("long")).alias("n_sure"), F.max("hop").alias("furthest"))


def _step(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(node_id, via): what edges, in either direction, lead to from ``frontier`` (node_id), each with its smallest predecessor.  A frontier whose size is checked and small is broadcast, so
    the edges are read without a shuffle."""
    at = frontier.select(F.col("node_id").alias("via"))
    at = F.broadcast(at) if small(at) else at
    out = edges.select(F.col("src").alias("via"), F.col("dst").alias("node_id")).join(at, "via")
    back = edges.select(F.col("dst").alias("via"), F.col("src").alias("node_id")).join(at, "via")
    return out.unionByName(back).groupBy("node_id").agg(F.min("via").alias("via"))


_REACHED = "node_id string, hop int, via string"


def _next_level(edges: DataFrame, seen: DataFrame, frontier: DataFrame, hop: int) -> DataFrame:
    new = _step(edges, frontier).join(seen.select("node_id"), "node_id", "left_anti")
    return work_table(new.select("node_id", F.lit(hop).alias("hop"), "via"), "frontier")


def hop_distance(edges: DataFrame, start: str, hops: int = 6) -> DataFrame:
    """(node_id, hop, via) over undirected edges; ``via`` is the smallest predecessor."""
    seen = frontier = edges.sparkSession.createDataFrame([(start, 0, None)], _REACHED)
    for hop in range(1, hops + 1):
        frontier = _next_level(edges, seen, frontier, hop)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 6) -> DataFrame:
    """(step, node_id) of one shortest undirected path, empty if there is none within ``hops``.  Of several shortest paths it is the one that, walked back from ``end``, always takes the smallest node.

    Two searches grow towards each other, always that with the smaller frontier, and meet by a join.  From where they meet, the nodes on shortest paths are followed
    to ``end`` level by level, each with its smallest predecessor; the driver then walks back over at most ``hops`` rows.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, node_id string")
    levels = {side: [spark.createDataFrame([(at, 0, None)], _REACHED)] for side, at in (("start", start), ("end", end))}
    size = {"start": 1, "end": 1}
    for _ in range(hops):
        side = min(size, key=lambda s: (size[s], s != "start"))
        own, other = levels[side], levels["end" if side == "start" else "start"]
        new = _next_level(edges, reduce(DataFrame.unionByName, own), own[-1], len(own))
        size[side] = new.count()
        if not size[side]:
            return spark.createDataFrame([], "step int, node_id string")
        own.append(new)
        # What is new can only lie on the other side's last level: anything nearer would have met before.
        met = new.select("node_id").join(other[-1].select("node_id"), "node_id", "left_semi")
        if not met.isEmpty():
            break
    else:
        return spark.createDataFrame([], "step int, node_id string")
    ahead, behind = levels["start"], levels["end"]
    on_path, tails = work_table(met, "met"), []
    for level in reversed(behind[:-1]):
        on_path = work_table(_step(edges, on_path).join(level.select("node_id"), "node_id", "left_semi"), "on-path")
        tails.insert(0, on_path)
    path, at = [end], end
    for level in [*tails, *reversed(ahead[1:])]:
        at = level.where(F.col("node_id") == at).first()["via"]
        path.append(at)
    return spark.createDataFrame([(len(path) - 1 - i, x) for i, x in enumerate(path)], "step int, node_id string")


def path_citations(edges: DataFrame, path: DataFrame) -> DataFrame:
    """(step, from_id, to_id, relation, confidence, line, forward) of each step of a path: its surest edge, in whichever direction it runs."""
    a, b = path.select("step", F.col("node_id").alias("from_id")), path.select((F.col("step") - 1).alias("step"), F.col("node_id").alias("to_id"))
    steps = F.broadcast(a.join(b, "step"))  # one row for each hop
    line = F.col("source_line") if "source_line" in edges.columns else F.lit(None).cast("int")
    rows = edges.select("src", "dst", "relation", "confidence", line.alias("line"))
    ways = rows.join(steps, (F.col("src") == F.col("from_id")) & (F.col("dst") == F.col("to_id"))).withColumn("forward", F.lit(True))
    ways = ways.unionByName(rows.join(steps, (F.col("dst") == F.col("from_id")) & (F.col("src") == F.col("to_id"))).withColumn("forward", F.lit(False)))
    best = ways.groupBy("step", "from_id", "to_id").agg(F.min(F.struct(confidence_rank(F.col("confidence")).alias("r"), (~F.col("forward")).alias("b"), "relation", "line", "confidence", "forward")).alias("w"))
    return best.select("step", "from_id", "to_id", "w.relation", "w.confidence", "w.line", "w.forward")


def path_gap(path: DataFrame, start: str, end: str, hops: int = 6) -> str | None:
    """What to say where no path was found; None if there is one."""
    return None if path.limit(1).count() else f"no path between {start} and {end} within {hops} hops"


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2, fanout: int = 50, most: int = 500) -> DataFrame:
    """Edges induced by the nodes within ``hops`` of the seeds, at most ``fanout`` followed from a node and ``most`` nodes; (src, dst, relation) once."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation", "src", "dst").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation", "src", "dst"))
    both = work_table(both.distinct(), "adjacency")
    seen = seeds.select("node_id", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        at = seen.where(F.col("hop") == hop - 1).select(F.col("node_id").alias("a"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy("relation", "src", "dst"))
        step = both.join(at, "a", "left_semi").withColumn("_r", rank).where(F.col("_r") <= fanout).select(F.col("b").alias("node_id")).distinct()
        seen = work_table(seen.unionByName(step.join(seen, "node_id", "left_anti").withColumn("hop", F.lit(hop))), "reached")
    kept = seen.orderBy("hop", "node_id").limit(most).select("node_id")
    ends = edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return ends.select("src", "dst", "relation").distinct()


def call_sequence(calls: list[tuple[str, str, int | None]], start: str, most: int = 200) -> list[tuple[str, str, int | None]]:
    """The calls made from ``start``, in the order of their lines and depth first; a call back into the open path is told but not followed.  ``calls`` is a bounded payload."""
    out: list[tuple[str, str, int | None]] = []
    by: dict[str, list[tuple[str, int | None]]] = {}
    for src, dst, line in sorted(calls, key=lambda c: (c[2] is None, c[2] or 0, c[1])):
        by.setdefault(src, []).append((dst, line))
    stack = [(start, iter(by.get(start, ())), {start})]
    while stack and len(out) < most:
        at, left, on_path = stack[-1]
        step = next(left, None)
        if step is None:
            stack.pop()
            continue
        out.append((at, *step))
        if step[0] not in on_path:
            stack.append((step[0], iter(by.get(step[0], ())), on_path | {step[0]}))
    return out


def call_sequences(calls: DataFrame, starts: DataFrame, most: int = 200, tasks: int | None = None) -> DataFrame:
    """(start, step, depth, src, dst, line, back) for every one of many starts (node_id): the calls (src, dst, line) made from it, in the order of their lines and depth first, at most
    ``most``; a call back into the open path is told (``back``) but not followed.  What ``call_sequence`` gives for one start on the driver.

    A call's place is the array of its ranks among the calls of each node on its path, so sorting by it walks depth first.  Of a node only the first ``most`` calls are kept, and a node is
    followed only while fewer than ``most`` calls are known to come before its own: both are exact, as later ones can only be pushed further behind.  Calls without a line come last, those
    with a null end are ignored; equal calls stay apart; null and repeated starts give nothing more.

    A round moves only the nodes that it reaches and that make calls, by numbers; calls lie in ``tasks`` buckets of their source, are not moved by rounds, and are joined to the nodes once, at the end."""
    n = tasks or int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = Window.partitionBy("src").orderBy(F.col("line").isNull(), "line", "dst")
    own = calls.where("src is not null and dst is not null").select("src", "dst", "line").repartition(n, "src")
    ranked = bucketed_table(own.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most), "ranked-calls", "src", n, dealt=True)
    callers = bucketed_table(ranked.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("id", F.monotonically_increasing_id()), "callers", "src", n)
    # Of each caller, by number, the calls that lead on to a caller: no more than ``most``.
    onward = ranked.select("src", "dst", "rank").join(callers.select(F.col("src").alias("dst"), "id", "n"), "dst").select("src", F.struct("rank", "id", "n").alias("to"))
    onward = onward.join(callers.select("src", F.col("id").alias("at")), "src").groupBy("at").agg(F.collect_list("to").alias("to"))
    onward = bucketed_table(onward, "onward-calls", "at", n)
    none, before = F.array().cast("array<int>"), F.sum("n").over(Window.partitionBy("start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    at = starts.where("node_id is not null").select(F.col("node_id").alias("start")).distinct()
    new = at.join(callers, F.col("start") == F.col("src")).select("start", F.col("id").alias("at"), "n", F.lit(0).cast("long").alias("pos"), none.alias("place"), F.array().cast("array<long>").alias("path"))
    reached = []
    while True:
        # How many calls come before a node's own, those of the nodes of its round included; a node that is too far behind stays without any.
        rows = new.withColumn("pos", F.col("pos") + F.coalesce(before, F.lit(0))).where(F.col("pos") < most)
        rows = rows.withColumn("path", F.concat("path", F.array("at"))).join(onward, "at", "left")
        open_ = F.filter("to", lambda x: ~F.array_contains("path", x["id"]) & (F.col("pos") + x["rank"] < most))
        back = F.transform(F.filter("to", lambda x: F.array_contains("path", x["id"])), lambda x: x["rank"])
        level = work_table(rows.select("start", "at", "pos", "place", "path", F.coalesce(back, none).alias("back"), open_.alias("to")), "call-places")
        reached.append(level.select("start", "at", "place", "back"))
        new = level.select("start", "pos", "place", "path", F.explode("to").alias("x")).select("start", F.col("x.id").alias("at"), "x.n", (F.col("pos") + F.col("x.rank")).alias("pos"), F.concat("place", F.array("x.rank")).alias("place"), "path")
        if new.isEmpty():
            break
    named = reduce(DataFrame.unionByName, reached).join(callers.select(F.col("id").alias("at"), "src"), "at").drop("at")
    rows = named.join(ranked, "src").select("start", F.concat("place", F.array("rank")).alias("place"), "src", "dst", "line", F.array_contains("back", F.col("rank")).alias("back"))
    within = Window.partitionBy("start").orderBy("place")
    rows = rows.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= most)
    return rows.select("start", (F.col("_r") - 1).alias("step"), F.size("place").alias("depth"), "src", "dst", "line", "back")
