"""Text forms of a payload of nodes and edges; one row each, lines in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a text form may have.
MOST_LINES = 20_000


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _document(lines: DataFrame, head: str, tail: str, name: str) -> DataFrame:
    """``lines`` (part, key, line) of a bounded payload, joined in order; a payload that is not bounded is refused."""
    if lines.limit(MOST_LINES + 1).count() > MOST_LINES:
        raise ValueError(f"a payload of more than {MOST_LINES} lines is not drawn; narrow it first")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(head), body, F.lit(tail)).alias(name))


def _both(nodes: DataFrame, edges: DataFrame, node: Column, edge: Column) -> DataFrame:
    n = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("key"), node.alias("line"))
    return n.unionByName(edges.select(F.lit(1).alias("part"), F.concat_ws("|", "src", "dst", "relation").alias("key"), edge.alias("line")))


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = F.col
    node = F.concat(F.lit("  "), _quoted(c("node_id")), F.lit(" [label="), _quoted(c("name")), F.lit("];"))
    edge = F.concat(F.lit("  "), _quoted(c("src")), F.lit(" -> "), _quoted(c("dst")), F.lit(" [label="), _quoted(c("relation")), F.lit("];"))
    return _document(_both(nodes, edges, node, edge), "digraph g {\n", "\n}", "dot")


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = F.col
    node = F.concat(F.lit('<node id="'), _escaped(c("node_id")), F.lit('"><data key="name">'), _escaped(c("name")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), _escaped(c("src")), F.lit('" target="'), _escaped(c("dst")), F.lit('"><data key="relation">'), _escaped(c("relation")), F.lit("</data></edge>"))
    return _document(_both(nodes, edges, node, edge), '<graphml><graph edgedefault="directed">\n', "\n</graph></graphml>", "graphml")


def to_cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = F.col
    node = F.concat(F.lit("MERGE (:Node {id: "), _quoted(c("node_id")), F.lit(", name: "), _quoted(c("name")), F.lit("});"))
    edge = F.concat(F.lit("MATCH (a {id: "), _quoted(c("src")), F.lit("}), (b {id: "), _quoted(c("dst")), F.lit("}) MERGE (a)-[:"), F.upper("relation"), F.lit("]->(b);"))
    return _document(_both(nodes, edges, node, edge), "", "", "cypher")


def to_mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = F.col
    label = F.regexp_replace(c("name"), r'["\[\]{}|<>]', " ")
    node = F.concat(F.lit("  "), c("node_id"), F.lit('["'), label, F.lit('"]'))
    edge = F.concat(F.lit("  "), c("src"), F.lit(" -->|"), c("relation"), F.lit("| "), c("dst"))
    return _document(_both(nodes, edges, node, edge), "graph LR\n", "", "mermaid")


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document of all columns of nodes and edges: {"nodes": [...], "edges": [...]}, each in order."""
    part = lambda rows, k, key: rows.select(F.lit(k).alias("part"), key.alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    lines = part(nodes, 0, F.col("node_id")).unionByName(part(edges, 1, F.concat_ws("|", "src", "dst", "relation")))
    if lines.limit(MOST_LINES + 1).count() > MOST_LINES:
        raise ValueError(f"a payload of more than {MOST_LINES} lines is not written as one document; narrow it first, or write rows")
    all_of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == k, F.struct("key", "line")))), lambda x: x["line"]), ",\n")
    return lines.agg(F.concat(F.lit('{"nodes": [\n'), all_of(0), F.lit('\n], "edges": [\n'), all_of(1), F.lit("\n]}")).alias("json"))
