"""Connected components of links between 64-bit nodes, by minimum labels and pointer jumping.

Each round joins links with labels, takes the smallest label next to a node (partial aggregates first, so a hub with many
links costs no more than they), hooks the label's own node onto it, and shortens paths.  Labels are written to the shared
folder each round, and are done when no link has two of them.  No links give no rows; null ends are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labels that are counted to be no more than these are broadcast.
_FEW = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node reachable."""
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = shared.table(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = shared.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    side = F.broadcast if labels.limit(_FEW + 1).count() <= _FEW else lambda df: df
    while True:
        at = lambda k: side(labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")))  # noqa: B023, E731
        if both.where("a < b").join(at("a"), "a").join(at("b"), "b").where("c_a <> c_b").isEmpty():
            return labels
        # Smallest label next to each node, and next to the node that carries its label.
        near = both.join(at("b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c_b").alias("m"))
        step = near.join(side(labels), "node").select("node", "component", F.least("component", "m").alias("m"))
        hooks = step.where(F.col("m") < F.col("component")).groupBy(F.col("component").alias("node")).agg(F.min("m").alias("h"))
        hooked = shared.table(step.join(side(hooks), "node", "left").select("node", F.least("m", F.coalesce("h", "m")).alias("component")), "hooked")
        up = side(hooked.select(F.col("node").alias("component"), F.col("component").alias("up")))
        short = hooked.join(up, "component").select("node", F.col("up").alias("component"))
        up = side(short.select(F.col("node").alias("component"), F.col("component").alias("up")))
        new = shared.table(short.join(up, "component").select("node", F.col("up").alias("component")), "labels")
        shared.drop_table(hooked)
        shared.drop_table(labels)
        labels = new


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``labels`` after further ``links(a, b)``, whose ends need not be in it: only the components that links join are worked on again."""
    at = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    named = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    moved = components(named.where("a <> b"))
    kept = labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return shared.table(kept.union(moved.join(labels, "node", "left_anti").select("node", "component")), "labels")
