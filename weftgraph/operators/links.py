"""Links between code and what surrounds it: flows of data, external systems, documents, merge requests and designs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.view import confidence_rank
from ..plans.work import small

#: Relations between code and external systems.
EXTERNAL = ["tracked_by", "documented_by", "designed_in", "has_merge_request", "has_issue", "touched_by", "discussed_in", "referenced_in"]
#: Kinds that hold others and are no callers.
CONTAINERS = ["file", "module", "namespace", "region", "package"]


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast where the side's size is checked and small, else the side as it is."""
    return F.broadcast(df) if small(df) else df


def data_flow(nodes: DataFrame, edges: DataFrame, repo: str, limit: int) -> DataFrame:
    """(src, relation, dst, name, kind, truncated): what a repository reads and writes, in order, at most ``limit`` rows; one row more is read to tell whether there are others."""
    flow = edges.where((F.col("repo_id") == repo) & F.col("relation").isin("reads", "writes"))
    rows = flow.join(nodes.select(F.col("node_id").alias("dst"), "name", "kind"), "dst").select("src", "relation", "dst", "name", "kind")
    head = rows.orderBy("name", "relation", "src").limit(limit + 1).withColumn("_r", F.row_number().over(Window.orderBy("name", "relation", "src")))
    return head.withColumn("truncated", F.max("_r").over(Window.partitionBy()) > limit).where(F.col("_r") <= limit).drop("_r")


def external_links(nodes: DataFrame, edges: DataFrame, source: Column, relations: list[str] | None = None) -> DataFrame:
    """(src, relation, n_links, names): out-edges of the sources in the external relations, grouped; names in order."""
    rows = edges.where(source & F.col("relation").isin(relations or EXTERNAL)).join(nodes.select(F.col("node_id").alias("dst"), "name"), "dst")
    return rows.groupBy("src", "relation").agg(F.count(F.lit(1)).alias("n_links"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def link_documents(matches: DataFrame, documents: DataFrame, relation: str, repo_edge: bool = True) -> DataFrame:
    """(src, dst, relation, confidence): an edge from every matched symbol (doc_id, node_id, confidence) to its document, and one from the document's repository to it, matched or not."""
    own = matches.select(F.col("node_id").alias("src"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dst"), F.lit(relation).alias("relation"), "confidence")
    if not repo_edge:
        return own
    return own.unionByName(documents.select(F.concat(F.lit("repo_"), F.col("repo_id")).alias("src"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dst"), F.lit(relation).alias("relation"), F.lit("INFERRED").alias("confidence")))


def match_files(changes: DataFrame, nodes: DataFrame, repo: Column | None = None) -> DataFrame:
    """(change_id, node_id, confidence): changed paths (change_id, repo_id, path) met with the file nodes of their repository, whose name is the path."""
    files = nodes.where("kind = 'file'").select("node_id", "repo_id", F.col("name").alias("path"))
    return changes.select("change_id", "repo_id", "path").distinct().join(files, ["repo_id", "path"]).select("change_id", "node_id", F.lit("EXTRACTED").alias("confidence"))


def match_names(frames: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(frame_id, node_id, confidence): names of design frames (frame_id, repo_id, name) met with symbols of their repository whatever their case."""
    named = nodes.where(F.col("kind").isin(kinds)).select("node_id", "repo_id", F.lower("name").alias("k"))
    own = frames.select("frame_id", "repo_id", F.lower(F.trim("name")).alias("k")).where("k <> ''").distinct()
    return own.join(named, ["repo_id", "k"]).select("frame_id", "node_id", F.lit("AMBIGUOUS").alias("confidence"))


def call_site_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, n_sites, n_callers, n_unattributed, first_file, first_line) of every called symbol: a site whose source only holds others, or is no node, names no caller."""
    sites = edges.where("relation = 'calls'").join(nodes.select(F.col("node_id").alias("src"), F.col("kind").alias("src_kind"), F.col("file").alias("src_file")), "src", "left")
    named = F.col("src_kind").isNotNull() & ~F.col("src_kind").isin(CONTAINERS)
    place = F.struct(F.coalesce("src_file", F.lit("")).alias("file"), F.coalesce("source_line", F.lit(0)).alias("line"))
    out = sites.groupBy("dst").agg(F.count(F.lit(1)).alias("n_sites"), F.count_distinct(F.when(named, F.col("src"))).alias("n_callers"), F.sum((~named).cast("long")).alias("n_unattributed"), F.min(place).alias("p"))
    return out.select("dst", "n_sites", "n_callers", "n_unattributed", F.col("p.file").alias("first_file"), F.col("p.line").alias("first_line"))


def api_symbols(nodes: DataFrame, edges: DataFrame, kinds: list[str], limit: int = 500) -> DataFrame:
    """(node_id, name, file, n_sites, rank, tied_out): the symbols with most call sites (then file, name, id), and how many others tie with the last in sites and were cut."""
    sites = edges.where("relation = 'calls'").groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_sites"))
    rows = nodes.where(F.col("kind").isin(kinds)).join(sites, "node_id", "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))
    order = (F.desc("n_sites"), F.asc_nulls_first("file"), "name", "node_id")
    head = rows.orderBy(*order).limit(limit).select("node_id", "name", "file", "n_sites", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    last = head.agg(F.min("n_sites").alias("least"), F.count(F.lit(1)).alias("n"))
    kept = head.join(F.broadcast(last), F.col("n_sites") == F.col("least")).agg(F.count(F.lit(1)).alias("kept"))
    all_ = rows.join(F.broadcast(last), F.col("n_sites") == F.col("least")).agg(F.count(F.lit(1)).alias("all"))
    return head.join(F.broadcast(kept)).join(F.broadcast(all_)).withColumn("tied_out", F.col("all") - F.col("kept")).drop("all", "kept")


def repo_edge_union(packages: DataFrame, http: DataFrame, events: DataFrame) -> DataFrame:
    """(src_repo, dst_repo, weight, flavour): the three kinds of edges between repositories, one after the other."""
    parts = [df.select("src_repo", "dst_repo", F.col("weight").cast("long").alias("weight"), F.lit(name).alias("flavour")) for name, df in (("package", packages), ("http", http), ("event", events))]
    return reduce(DataFrame.unionByName, parts)


def project_nodes(nodes: DataFrame, score: Column | None = None) -> DataFrame:
    """The wire form of nodes: id, repo, kind, name, file:line as the citation, signature and doc from attrs where there are some, the score with four places."""
    attrs = "attrs" in nodes.columns
    attr = lambda k: (F.get_json_object("attrs", f"$.{k}") if attrs else F.lit(None).cast("string")).alias(k)
    cite = F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", F.col("line_start").cast("string")))
    own = [] if score is None else [F.round(score, 4).alias("score")]
    return nodes.select(F.col("node_id").alias("id"), F.col("repo_id").alias("repo"), "kind", "name", cite.alias("cite"), attr("signature"), attr("doc"), *own)


def project_edges(edges: DataFrame) -> DataFrame:
    """The wire form of edges, with their place."""
    line = F.col("source_line") if "source_line" in edges.columns else F.lit(None).cast("int")
    return edges.select("src", "dst", "relation", "confidence", confidence_rank(F.col("confidence")).alias("conf_rank"), line.alias("line"))


def external_context(documents: DataFrame, most_items: int = 8, most_chars: int = 300) -> DataFrame:
    """(repo_id, source, title, snippet, rank): of each repository's enrichment documents the first ones in order, blanks joined and cut.  Only ids and order are ranked."""
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, most_chars)
    rows = documents.select("repo_id", "doc_id", "source", F.coalesce(F.trim("title"), F.lit("")).alias("title"), clean.alias("snippet")).where("title <> '' or snippet <> ''")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("doc_id", "title", "snippet"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most_items).select("repo_id", "source", "title", "snippet", "rank")


def build_terms(ranked: DataFrame, most: int = 8) -> DataFrame:
    """(repo_id, term, rank): the repository's last path segment, then the names of its best symbols (repo_id, name, degree), each once; what to look for in external systems."""
    own = ranked.select("repo_id", F.element_at(F.split("repo_id", "/"), -1).alias("term"), F.lit(None).cast("long").alias("d")).distinct()
    terms = own.unionByName(ranked.select("repo_id", F.col("name").alias("term"), F.col("degree").cast("long").alias("d")))
    once = terms.where(F.length("term") >= 3).groupBy("repo_id", "term").agg(F.max(F.col("d").isNull().cast("int")).alias("own"), F.max("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("own"), F.desc("d"), "term"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("repo_id", "term", "rank")
