"""Whether a graph and what is written about it can be trusted: health, citations, drift, quality gates, and the brief of a repository."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import bucketed_table, work_table
from ..sources.files import is_generated
from . import graph, text

#: Citations confirmed for one drift probe, lines around a citation that may hold the name.
DRIFT_BUDGET, WINDOW = 32, 2


def graph_health(repos: DataFrame, nodes: DataFrame, edges: DataFrame, parser: str) -> DataFrame:
    """One row: repos, checked (edges), stale, empty, shard, unreadable, parser_stale, dangling.

    Repositories (repo_id, head, indexed_head, indexed_parser, state); state tells why there is no head: empty, shard, missing or unreadable.  A repository
    whose head moved and whose parser is old counts under both.
    """
    moved = ~F.col("head").eqNullSafe(F.col("indexed_head")) | ~F.col("indexed_parser").eqNullSafe(F.lit(parser)) | F.col("head").isNull()
    why = F.when(F.col("head").isNotNull(), "ok").otherwise(F.coalesce("state", F.lit("ok")))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    counts = repos.agg(
        F.count(F.lit(1)).alias("repos"), n(moved & ~why.isin("empty", "shard", "missing", "unreadable")).alias("stale"), n(moved & (why == "empty")).alias("empty"), n(moved & (why == "shard")).alias("shard"), n(moved & why.isin("missing", "unreadable")).alias("unreadable"),
        n(~F.col("indexed_parser").eqNullSafe(F.lit(parser))).alias("parser_stale"))
    known = nodes.select("node_id").distinct().withColumn("_ok", F.lit(True))
    side = lambda at: known.select(F.col("node_id").alias(at), F.col("_ok").alias(f"_{at}"))
    ends = edges.select("src", "dst").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    checked = ends.agg(F.count(F.lit(1)).alias("checked"), n(F.col("_src").isNull() | F.col("_dst").isNull()).alias("dangling"))
    return counts.join(F.broadcast(checked))  # one row each


def verify_citations(nodes: DataFrame, repos: DataFrame, lines: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(node_id, status, reason, cite) of wanted ids, from nodes (node_id, repo_id, kind, name, file, line_start, lang), repos (repo_id, checkout) and the lines of files (repo_id, file, line, text).

    verified; broken: node_missing, no_citation, file_missing, line_out_of_range, name_absent; unverifiable: checkout_missing.  A file node is verified by its path alone, names in SQL
    whatever their case.  A citation reads only the lines around it, by an equality join on the few line numbers of its window.
    """
    c = wanted.select("node_id").distinct().join(nodes.select("node_id", "repo_id", "kind", "name", "file", "line_start", "lang", F.lit(True).alias("_n")), "node_id", "left")
    c = c.join(repos.select("repo_id", "checkout"), "repo_id", "left")
    length = lines.groupBy("repo_id", "file").agg(F.max("line").alias("last"))
    c = c.join(length, ["repo_id", "file"], "left")
    near = c.where(F.col("line_start").isNotNull()).select("node_id", "repo_id", "file", "name", "lang", F.explode(F.sequence(F.col("line_start") - window, F.col("line_start") + window)).alias("line"))
    case = lambda x: F.when(F.col("lang") == "sql", F.lower(x)).otherwise(x)
    hit = near.join(lines.select("repo_id", "file", "line", "text"), ["repo_id", "file", "line"]).where(case(F.col("text")).contains(case(F.col("name")))).select("node_id").distinct().withColumn("_hit", F.lit(True))
    c = c.join(hit, "node_id", "left")
    reason = (
        F.when(F.col("_n").isNull(), "node_missing").when(F.col("file").isNull(), "no_citation").when(~F.coalesce("checkout", F.lit(False)), "checkout_missing").when(F.col("last").isNull(), "file_missing").when(F.col("kind") == "file", "")
        .when(F.coalesce("line_start", F.lit(0)) == 0, "no_citation").when(F.col("line_start") > F.col("last"), "line_out_of_range").when(F.col("_hit").isNull(), "name_absent").otherwise("")
    )
    status = F.when(reason == "", "verified").when(reason == "checkout_missing", "unverifiable").otherwise("broken")
    return c.select("node_id", status.alias("status"), reason.alias("reason"), F.coalesce(F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", F.col("line_start").cast("string"))), F.lit("")).alias("cite"))


def citation_summary(checks: DataFrame) -> DataFrame:
    """(checked, verified, broken, unverifiable, verified_rate, reasons): the rate over what could be checked, null if nothing; reasons as reason=n, the most frequent first."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    total = checks.agg(F.count(F.lit(1)).alias("checked"), n("verified"), n("broken"), n("unverifiable"))
    by = checks.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))  # a handful of rows
    told = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason"))), lambda x: F.concat_ws("=", x["reason"], (-x["m"]).cast("string"))), ",").alias("reasons"))
    rate = F.round(F.col("verified") / F.nullif(F.col("verified") + F.col("broken"), F.lit(0)), 4)
    return total.join(F.broadcast(told)).select("checked", "verified", "broken", "unverifiable", rate.alias("verified_rate"), "reasons")


def drift(answer: DataFrame, files: DataFrame, checks: DataFrame, budget: int = DRIFT_BUDGET) -> DataFrame:
    """(rank, node_id, state) of an answer's rows (rank, node_id, repo_id, file, indexed_at): current where the file has not changed since it was indexed, else what its citation check says
    (confirmed, drifted or unknown) for the first ``budget`` of those, unchecked beyond, and unknown where the file is not there.  files (repo_id, file, mtime)."""
    rows = answer.join(files, ["repo_id", "file"], "left")
    gate = F.when(F.col("mtime").isNull(), "unknown").when(F.col("mtime") <= F.col("indexed_at"), "current")
    rows = rows.withColumn("gate", gate)
    # The budget goes by rank among the rows that need a check: the last rank within it is that of a top-k, so no task sorts all rows.
    last = rows.where(F.col("gate").isNull()).select("rank").orderBy("rank").limit(budget).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    rows = rows.join(F.broadcast(last)).join(checks.select("node_id", "status"), "node_id", "left")
    told = F.when(F.col("status") == "verified", "confirmed").when(F.col("status") == "broken", "drifted").otherwise("unknown")
    return rows.select("rank", "node_id", F.coalesce("gate", F.when((F.col("n") == budget) & (F.col("rank") > F.col("last")), "unchecked").otherwise(told)).alias("state"))


def structural_gate(drafts: DataFrame, instructions: DataFrame) -> DataFrame:
    """(doc_id, accepted, reason): a draft that shares a span of words with an instruction leaks it, one that repeats itself loops; leakage is told first."""
    leaks = text.leaked_spans(drafts, instructions).select("doc_id").distinct().withColumn("_leak", F.lit(True))
    loops = text.repeats(drafts).where("looping").select("doc_id").distinct().withColumn("_loop", F.lit(True))
    rows = drafts.select("doc_id").distinct().join(leaks, "doc_id", "left").join(loops, "doc_id", "left")
    reason = F.when(F.col("_leak"), "prompt leakage").when(F.col("_loop"), "degenerate repetition").otherwise("")
    return rows.select("doc_id", (reason == "").alias("accepted"), reason.alias("reason"))


def ticked(page: Column) -> Column:
    """The distinct names in back-ticks of a text."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"`([^`\n]+)`"), F.lit(1)))


def replacement_gate(pages: DataFrame, sections: list[str]) -> DataFrame:
    """(page_id, accepted, reason, names) of drafts against the page each would replace (page_id, draft, page): names in back-ticks that the page lacks are invented; a section of
    the page (a heading of ``sections``) whose names in back-ticks the draft all leaves out is missing."""
    invented = F.array_sort(F.array_except(ticked(F.col("draft")), ticked(F.col("page"))))
    body = lambda s: F.regexp_extract("page", rf"(?ms)^#+ {s}\s*$(.*?)(?=^#+ |\z)", 1)
    said = lambda names: F.exists(names, lambda n: F.contains(F.col("draft"), n))
    missing = F.array_compact(F.array(*[F.when((F.size(ticked(body(s))) > 0) & ~said(ticked(body(s))), F.lit(s)) for s in sections]))
    rows = pages.select("page_id", invented.alias("invented"), missing.alias("missing"))
    reason = F.when(F.size("invented") > 0, "cites names the graph does not hold").when(F.size("missing") > 0, "less complete than the page").otherwise("")
    names = F.when(F.size("invented") > 0, F.col("invented")).otherwise(F.col("missing"))
    return rows.select("page_id", (reason == "").alias("accepted"), reason.alias("reason"), F.array_join(names, ",").alias("names"))


def grounding_cap(n: Column) -> Column:
    """How many symbols a brief lists: one for each 1,500 nodes, 15 at least and 80 at most."""
    return F.greatest(F.lit(15), F.least(F.lit(80), F.floor(n / 1500))).cast("int")


def repo_brief(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, n_nodes, n_files, n_edges, cap, n_grounded, kinds) of every repository: its size, the symbols a brief would name among those with a file, and its kinds as kind=n in order.

    Degrees count distinct pairs of relations with an edge for each site.  A repository's best symbols are ranked per repository behind a partial top of each salt, so that the largest is spread over tasks.
    """
    degree = graph.distinct_degree(edges)
    rows = nodes.select("repo_id", "node_id", "kind", "file").join(degree.select("node_id", "degree"), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    by_kind = nodes.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_kind.groupBy("repo_id").agg(F.sum("n").cast("long").alias("n_nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))), lambda x: F.concat_ws("=", x["kind"], (-x["m"]).cast("string"))), ",").alias("kinds"))
    files = nodes.groupBy("repo_id").agg(F.count_distinct("file").alias("n_files"))
    n_edges = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges"))
    order = (F.desc("degree"), "node_id")
    first = rows.withColumn("_w", F.row_number().over(Window.partitionBy("repo_id", F.pmod(F.xxhash64("node_id"), F.lit(64))).orderBy(*order))).where("_w <= 80")
    best = first.withColumn("_r", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).where("_r <= 80")
    sized = best.join(kinds.select("repo_id", grounding_cap(F.col("n_nodes")).alias("cap")), "repo_id").where("_r <= cap")
    grounded = sized.groupBy("repo_id").agg(F.max("cap").alias("cap"), F.sum(F.col("file").isNotNull().cast("long")).alias("n_grounded"))
    return kinds.join(files, "repo_id").join(n_edges, "repo_id", "left").join(grounded, "repo_id").select("repo_id", "n_nodes", "n_files", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "cap", "n_grounded", "kinds")


#: Names of a list of packages, files or decisions that a brief holds; what is left out is counted.
LISTED = 20
_MOST, _SALTS = 80, 4


def floored(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """(repo_id, node_id, kind, name, n, place): of each repository the ``cap`` best rows by n and id (caps: repo_id, cap of at most 80), where kinds that miss get the place of their best row, at most half of
    them, and the tail makes room.  Both are among the best of each kind, which are found once, behind a partial top of each salt, and written: no more than ``_MOST`` rows for each kind and salt."""
    order = (F.desc("n"), "node_id")
    salted = F.row_number().over(Window.partitionBy("repo_id", "kind", F.pmod(F.xxhash64("node_id"), F.lit(_SALTS))).orderBy(*order))
    first = work_table(rows.select("repo_id", "node_id", "kind", "name", "n").withColumn("_w", salted).where(F.col("_w") <= _MOST).drop("_w"), "best")
    head = first.withColumn("_r", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).join(caps, "repo_id").where(F.col("_r") <= F.col("cap"))
    best = first.groupBy("repo_id", "kind").agg(F.min(F.struct((-F.col("n")).alias("m"), "node_id", "name")).alias("b")).select("repo_id", "kind", (-F.col("b.m")).alias("n"), "b.node_id", "b.name")
    lost = best.join(head.select("repo_id", "kind").distinct(), ["repo_id", "kind"], "left_anti").join(caps, "repo_id")
    lost = lost.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).where(F.col("_k") <= F.floor(F.col("cap") / 2))
    slots = lost.groupBy("repo_id").agg(F.count(F.lit(1)).alias("slots"))
    kept = head.join(slots, "repo_id", "left").where(F.col("_r") <= F.col("cap") - F.coalesce("slots", F.lit(0)))
    return kept.select("repo_id", "node_id", "kind", "name", "n", F.col("_r").alias("place")).unionByName(lost.select("repo_id", "node_id", "kind", "name", "n", (F.lit(1000) + F.col("_k")).alias("place")))


def _told(rows: DataFrame, by: list, value: Column, name: str, most: int | None = None) -> DataFrame:
    """(repo_id, name): the values of each repository's rows in order, the first ``most`` of them."""
    if most:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id").orderBy(*by))).where(F.col("_n") <= most)
    items = F.array_sort(F.collect_list(F.struct(*[F.col(b) if isinstance(b, str) else b for b in by], value.alias("_v"))))
    return rows.groupBy("repo_id").agg(F.array_join(F.transform(items, lambda x: x["_v"]), ",").alias(name))


def whole_brief(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each repository with all that a brief holds: n_nodes, n_files, n_edges, coverage_total (nodes with a file), grounded_count (those of them that one of the lists names), kinds and langs (name=n),
    top_symbols (by degree, every kind with a place), hubs and dispatchers (name=callers, name=callees), own and needed packages with their numbers, the first files, decisions, and whether generated files were seen.

    Lists of symbols have ``grounding_cap`` places, others ``LISTED``; lists of a repository are bounded, and so are the kinds, so no task gathers a repository.
    Shuffles of edges have at least ``tasks`` partitions.
    """
    degree = graph.distinct_degree(edges)
    # Degrees are met once; the three lists read them from there.
    rows = work_table(nodes.select("repo_id", "node_id", "kind", "name").join(degree, "node_id", "left"), "degrees", tasks=tasks)
    size = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("file").alias("n_files"), F.count("file").alias("coverage_total"))
    size = work_table(size, "sizes")
    caps = size.select("repo_id", grounding_cap(F.col("n_nodes")).alias("cap"))
    ranked = {}
    for name, column, at_least in (("top_symbols", "degree", F.lit(True)), ("hubs", "n_in", F.col("n_in") > 0), ("dispatchers", "n_out", F.col("n_out") > 0)):
        ranked[name] = work_table(floored(rows.where(at_least).withColumn("n", F.coalesce(column, F.lit(0))), caps), "ranked")
    counted = F.concat_ws("=", "name", F.col("n").cast("string"))
    lists = [_told(r, ["place"], F.col("name") if name == "top_symbols" else counted, name) for name, r in ranked.items()]
    named = functools.reduce(DataFrame.unionByName, [r.select("repo_id", "node_id") for r in ranked.values()]).distinct()
    placed = nodes.where(F.col("file").isNotNull()).select("node_id").join(named.select("node_id").distinct(), "node_id", "left_semi").distinct()  # only what is listed, so that no node is moved for it
    grounded = named.join(placed, "node_id", "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("grounded_count"))
    for column, name in (("kind", "kinds"), ("lang", "langs")):
        n = nodes.where(F.col(column).isNotNull()).groupBy("repo_id", column).agg((-F.count(F.lit(1))).alias("m"))
        lists.append(_told(n, ["m", column], F.concat_ws("=", column, (-F.col("m")).cast("string")), name))
    # A package of a repository is its own if it publishes it, else needed: told by one group of both relations.  They lie in buckets of packages, so that names meet them where they lie.
    ends = edges.where(F.col("relation").isin("publishes", "depends_on")).select("repo_id", "dst", (F.col("relation") == "publishes").alias("own"))
    n = tasks or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packages = bucketed_table(ends.repartition(n, "dst").groupBy("repo_id", "dst").agg(F.max("own").alias("own")), "brief-packages", "dst", n, dealt=True)
    place = F.row_number().over(Window.partitionBy("repo_id", "own").orderBy("name", "dst"))
    first = packages.join(nodes.select(F.col("node_id").alias("dst"), "name"), "dst").withColumn("_n", place).where(F.col("_n") <= LISTED).drop("_n")
    first = work_table(first, "first-packages", tasks=tasks)
    n_packages = packages.groupBy("repo_id", "own").agg(F.count(F.lit(1)).alias("n"))
    for own, name in ((True, "own_packages"), (False, "needed_packages")):
        lists += [_told(first.where(F.col("own") == own), ["name", "dst"], F.col("name"), name, LISTED), n_packages.where(F.col("own") == own).select("repo_id", F.col("n").alias(f"n_{name}"))]
    files = nodes.where(F.col("file").isNotNull()).select("repo_id", "file").distinct()
    lists.append(_told(files, ["file"], F.col("file"), "files", LISTED))
    lists.append(_told(nodes.where("kind = 'adr'"), ["name", "node_id"], F.col("name"), "decisions", LISTED))
    made = files.groupBy("repo_id").agg(F.max(F.array_contains(F.split(F.lower("file"), "/"), "generated") | is_generated(F.col("file"), F.lit(""))).alias("generated"))
    out = size.join(edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges")), "repo_id", "left").join(grounded, "repo_id", "left").join(made, "repo_id", "left")
    for x in lists:
        out = out.join(x, "repo_id", "left")
    blank = {"n_edges": 0, "grounded_count": 0, "n_own_packages": 0, "n_needed_packages": 0, **{c: "" for c in ("top_symbols", "hubs", "dispatchers", "kinds", "langs", "own_packages", "needed_packages", "files", "decisions")}}
    return out.fillna(blank).withColumn("generated", F.coalesce("generated", F.lit(False)))
