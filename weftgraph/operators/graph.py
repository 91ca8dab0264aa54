"""Point lookups, joins, aggregates and rankings over nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.view import PER_SITE, confidence_rank
from ..plans.work import small
from . import search


# ---- lookups


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def nodes_by_name(nodes: DataFrame, name: str, kind: str | None = None, repo: str | None = None) -> DataFrame:
    out = nodes.where(F.col("name") == name)
    out = out.where(F.col("kind") == kind) if kind else out
    return out.where(F.col("repo_id") == repo) if repo else out


def neighbors(edges: DataFrame, node_id: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Edges at a node; with both directions a self-loop appears once."""
    tests = {"out": F.col("src") == node_id, "in": F.col("dst") == node_id, "both": (F.col("src") == node_id) | (F.col("dst") == node_id)}
    if direction not in tests:
        raise ValueError(f"direction must be one of {', '.join(tests)}")
    out = edges.where(tests[direction])
    return out.where(F.col("relation") == relation) if relation else out


def in_path(file: Column, prefix: str) -> Column:
    """The path itself or what lies below it."""
    return (file == prefix) | file.startswith(prefix + "/")


def is_real_repo(repo: Column) -> Column:
    """Neither a sentinel such as (packages) nor a partition such as @connect:x."""
    return ~repo.rlike(r"^[(@]")


def repo_scope(repo: str) -> list[str]:
    return [repo, f"@connect:{repo}", f"@enrich:{repo}"]


def in_scope(rows: DataFrame, repos: DataFrame | None) -> DataFrame:
    """The rows (repo_id) of some repositories (repo_id), with those of their connectors and enrichments; all rows without any are asked for."""
    if repos is None:
        return rows
    parts = repos.select(F.explode(F.array("repo_id", F.concat(F.lit("@connect:"), "repo_id"), F.concat(F.lit("@enrich:"), "repo_id"))).alias("repo_id")).distinct()
    return rows.join(F.broadcast(parts) if small(parts) else parts, "repo_id", "left_semi").select(*rows.columns)


def glob_pattern(glob: str) -> str:
    """A case-insensitive pattern, anchored at both ends, for a glob of * and ?."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def repos_matching(nodes: DataFrame, glob: str) -> DataFrame:
    return nodes.select("repo_id").distinct().where(F.col("repo_id").rlike(glob_pattern(glob)))


def budget(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """At most ``limit`` rows in order, with the total and whether some were cut."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(max(0, limit)).join(F.broadcast(total)).withColumn("truncated", F.col("total") > max(0, limit))


#: Kinds that an impact walk may start from before others of the same name.
SOURCE_KINDS = ["class", "function", "interface", "method", "struct", "enum", "table", "view"]


def resolve_target(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Candidates by tier: exact id, exact name, words that begin with every term of the name; only the first tier that has any, source kinds before others, files without "test" before
    others, then by id; at most ``limit``."""
    terms = [t for t in re.split(r"[^a-z0-9]+", name.lower()) if t]
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != "")
    lexical = F.lit(bool(terms))
    for t in terms:
        lexical = lexical & search.begins(words, t)
    tier = F.when(F.col("node_id") == name, 0).when(F.col("name") == name, 1).when(lexical, 2)
    hits = nodes.withColumn("tier", tier).where(F.col("tier").isNotNull())
    first = hits.agg(F.min("tier").alias("tier"))
    test = F.coalesce(F.lower("file").contains("test"), F.lit(False))
    ranked = hits.join(F.broadcast(first), "tier").orderBy((~F.col("kind").isin(SOURCE_KINDS)).cast("int"), test.cast("int"), "node_id").limit(limit)
    return ranked.select("node_id", "name", "kind", "repo_id", "tier")


def miss_note(nodes: DataFrame, name: str, kind: str | None = None, repo: str | None = None) -> str | None:
    """Why a definition was not found: it is nowhere, or only where the filters don't look.  None if it was found."""
    if nodes_by_name(nodes, name, kind, repo).limit(1).count():
        return None
    others = nodes_by_name(nodes, name).limit(1).count()
    return f"{name} is defined, but not with these filters" if others else f"{name} is not in the graph"


# ---- joins


def repo_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repositories that depend on a package which another one publishes; weight: distinct packages."""
    repo = nodes.select("node_id", F.col("repo_id").alias("r"))
    of = lambda relation, name: edges.where(F.col("relation") == relation).join(repo, F.col("src") == F.col("node_id")).select("dst", F.col("r").alias(name)).distinct()
    both = of("depends_on", "src_repo").join(of("publishes", "dst_repo"), "dst").where(F.col("src_repo") != F.col("dst_repo"))
    # Both sides are distinct, so a package meets a pair once and is counted where it is joined: the pairs of a package are not shuffled.
    return both.groupBy("src_repo", "dst_repo").agg(F.count(F.lit(1)).alias("weight"))


def two_hop(left: DataFrame, right: DataFrame, on: str, left_repo: str, right_repo: str) -> DataFrame:
    """Repository pairs that meet at an endpoint or topic; weight: distinct meeting points."""
    a, b = left.select(on, F.col(left_repo).alias("src_repo")).distinct(), right.select(on, F.col(right_repo).alias("dst_repo")).distinct()
    return a.join(b, on).where(F.col("src_repo") != F.col("dst_repo")).groupBy("src_repo", "dst_repo").agg(F.count(F.lit(1)).alias("weight"))  # a meeting point meets a pair once


def external_systems(called: DataFrame, exposed: DataFrame, host: str) -> DataFrame:
    """Calls to endpoints that nothing exposes, by caller and host."""
    return called.join(exposed.select("endpoint").distinct(), "endpoint", "left_anti").groupBy("repo", host).agg(F.count(F.lit(1)).alias("n_calls"))


def flag_cross_repo(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with cross_repo: both ends known and in different repositories."""
    side = lambda at: nodes.select(F.col("node_id").alias(at), F.col("repo_id").alias(f"{at}_repo"))
    known = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return known.withColumn("cross_repo", F.coalesce(F.col("src_repo") != F.col("dst_repo"), F.lit(False)))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, in one pass over them."""
    known = nodes.select("node_id").distinct().withColumn("_ok", F.lit(True))
    side = lambda at: known.select(F.col("node_id").alias(at), F.col("_ok").alias(f"_{at}"))
    rows = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where(F.col("_src").isNull() | F.col("_dst").isNull())
    return rows.select(*edges.columns)


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # Ends are not made distinct: an anti-join does without, and a list of them would be nearly as long.
    return nodes.join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def call_sites(nodes: DataFrame, edges: DataFrame, node_id: str, callers: bool) -> DataFrame:
    """One row for each place of a call at ``node_id``, surest first, with the number of distinct other ends."""
    here, there = ("dst", "src") if callers else ("src", "dst")
    sites = edges.where((F.col("relation") == "calls") & (F.col(here) == node_id)).join(nodes, F.col(there) == F.col("node_id"))
    distinct = sites.agg(F.count_distinct("node_id").alias("n_distinct"))
    rows = sites.select("node_id", "name", nodes["repo_id"], "confidence", confidence_rank(F.col("confidence")).alias("conf_rank"), "source_line")
    return rows.join(F.broadcast(distinct))


def sources_of(nodes: DataFrame, edges: DataFrame, target: DataFrame, relation: str) -> DataFrame:
    """Distinct nodes with an edge of ``relation`` to a target: subclasses, dependents."""
    at = edges.where(F.col("relation") == relation).join(target.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")
    return nodes.join(at.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_semi")


def resolve_names(refs: DataFrame, definitions: DataFrame, cap: int = 6) -> DataFrame:
    """References (src, name) meet definitions by name.  One candidate is INFERRED, up to ``cap`` are AMBIGUOUS, more are dropped; a reference
    to itself is no edge.  The fan-out is counted on both sides before they meet, so no name expands into pairs that are dropped."""
    d = definitions.select("name", F.col("node_id").alias("dst"))
    fan = d.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap + 1)
    pairs = refs.select("src", "name").distinct().join(d.join(fan, "name"), "name").where(F.col("src") != F.col("dst"))
    n = F.count(F.lit(1)).over(Window.partitionBy("src", "name"))
    return pairs.withColumn("candidates", n).where(F.col("candidates") <= cap).select("src", "dst", "candidates", F.when(F.col("candidates") == 1, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"))


#: Languages that call into each other, by family; any other is a family of its own.
FAMILIES = {"javascript": "js", "typescript": "js", "tsx": "js", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm", "scala": "jvm"}
#: Fixed value: a name with more definitions than this says nothing.
MOST_CANDIDATES = 6


def family(lang: Column) -> Column:
    """The interoperating family of a language; null where it is not known."""
    names = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(F.element_at(names, lang), lang)


def resolve_references(refs: DataFrame, definitions: DataFrame, relation: str, kinds: list[str], same_language: bool = True, per_site: bool = False, cap: int = MOST_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, relation, confidence, candidates, file, line) that references (src, name, lang, file, line) mean, and counts of what became of the references
    (resolved, ambiguous, dropped).

    Candidates are definitions (node_id, name, kind, lang, file, internal) of one of ``kinds``; with ``same_language`` those of the reference's family or of none.  Those that
    other files can see, or that stand in the reference's own file, are preferred; if there are none, all stay.  One candidate is INFERRED, up to ``cap``
    AMBIGUOUS, more are dropped and counted; a reference to itself is no edge.  An edge for each site, or for each pair that with the smallest line.

    Candidates are counted by (name, family, visibility) before any reference meets them, so a name with many definitions never expands.
    """
    own = definitions.where(F.col("kind").isin(kinds)).select("name", F.col("node_id").alias("dst"), family(F.col("lang")).alias("f"), F.col("file").alias("at"), F.coalesce("internal", F.lit(False)).alias("internal")).distinct()
    any_, none = F.lit("*any"), F.lit("*none")
    # A definition is found under its family, one of no family under "none", and everything under "any".
    own = own.withColumn("key", F.explode(F.array(any_, F.coalesce("f", none))))
    sites = refs.select("src", "name", family(F.col("lang")).alias("f"), "file", "line").withColumn("_id", F.xxhash64("src", "name", "f", "file"))
    uses = sites.select("src", "name", "f", "file").distinct()
    seen_as = F.when(F.col("f").isNull(), F.array(any_)).otherwise(F.array(F.col("f"), none)) if same_language else F.array(any_)
    keyed = uses.withColumn("key", F.explode(seen_as))
    total = own.groupBy("name", "key").agg(F.sum((~F.col("internal")).cast("long")).alias("n_ext"), F.count(F.lit(1)).alias("n_all"))
    local = own.where("internal").groupBy("name", "key", F.col("at").alias("file")).agg(F.count(F.lit(1)).alias("n_own"))
    counted = keyed.join(total, ["name", "key"]).join(local, ["name", "key", "file"], "left")
    per = counted.groupBy("src", "name", "f", "file").agg(F.sum("n_ext").alias("e"), F.sum(F.coalesce("n_own", F.lit(0))).alias("o"), F.sum("n_all").alias("a"))
    per = per.withColumn("candidates", F.when(F.col("e") + F.col("o") > 0, F.col("e") + F.col("o")).otherwise(F.col("a")))
    fits = per.where(F.col("candidates") <= cap).withColumn("key", F.explode(seen_as))
    preferred = F.col("e") + F.col("o") > 0
    ext = own.where("not internal").select("name", "key", "dst")
    inner = own.where("internal").select("name", "key", "dst", F.col("at").alias("file"))
    cols = ["src", "name", "f", "file", "candidates", "dst"]
    met = fits.where(preferred & (F.col("e") > 0)).join(ext, ["name", "key"]).select(*cols)
    met = met.unionByName(fits.where(preferred & (F.col("o") > 0)).join(inner, ["name", "key", "file"]).select(*cols))
    met = met.unionByName(fits.where(~preferred).join(inner.drop("file"), ["name", "key"]).select(*cols)).where("src <> dst")
    out = sites.alias("s").join(met.alias("m"), (F.col("s.src") == F.col("m.src")) & (F.col("s.name") == F.col("m.name")) & F.col("s.file").eqNullSafe(F.col("m.file")) & F.col("s.f").eqNullSafe(F.col("m.f")))
    confidence = F.when(F.col("candidates") == 1, "INFERRED").otherwise("AMBIGUOUS")
    edges = out.select("m.src", "m.dst", F.lit(relation).alias("relation"), confidence.alias("confidence"), F.col("candidates").cast("int").alias("candidates"), "s.file", "s.line").distinct()
    if not per_site:
        first = F.min(F.struct("line", "file", "confidence", "candidates")).alias("w")
        edges = edges.groupBy("src", "dst", "relation").agg(first).select("src", "dst", "relation", "w.confidence", "w.candidates", "w.file", "w.line")
    fate = F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") <= cap, "ambiguous").otherwise("dropped")
    counts = sites.join(per.select(F.xxhash64("src", "name", "f", "file").alias("_id"), "candidates"), "_id").groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))
    return edges, counts


def resolve_methods(pending: DataFrame, classes: DataFrame) -> DataFrame:
    """(node_id, class_id): methods defined out of line, by their qualifier (node_id, qualifier such as NS.Box), and the one class it means: that whose chain is
    the whole qualifier, else the one whose chain ends with it.  No class, or several, leaves the method where it is.

    Classes are (node_id, name, chain).  Suffixes meet by the bare name, in which classes are few; names that more than a thousand classes share are
    decided by counts of whole chains and of their suffixes, which are looked up by equality.
    """
    c = classes.select(F.col("node_id").alias("class_id"), "chain")
    parts = F.split("chain", r"\.")
    # Every suffix of a chain on a segment's bound is a key; a chain has few segments.
    keyed = c.withColumn("qualifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    per = keyed.withColumn("whole", F.col("qualifier") == F.col("chain")).groupBy("qualifier").agg(
        F.sum(F.col("whole").cast("int")).alias("n_whole"), F.min(F.when(F.col("whole"), F.col("class_id"))).alias("whole_id"), F.count(F.lit(1)).alias("n_any"), F.min("class_id").alias("any_id"))
    met = pending.select("node_id", "qualifier").join(per, "qualifier")
    found = F.when(F.col("n_whole") == 1, F.col("whole_id")).when(F.col("n_any") == 1, F.col("any_id"))
    return met.select("node_id", found.alias("class_id")).where(F.col("class_id").isNotNull())


def reconcile(edges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Ambiguous edges stay only if their key is confirmed, and are then inferred; others stay as they are."""
    c = confirmed.select("key").distinct().withColumn("_ok", F.lit(True))
    joined = edges.join(c, "key", "left")
    keep = joined.where((F.col("confidence") != "AMBIGUOUS") | F.col("_ok"))
    return keep.withColumn("confidence", F.when(F.col("confidence") == "AMBIGUOUS", "INFERRED").otherwise(F.col("confidence"))).drop("_ok")


# ---- aggregates and ranks


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, n): nodes, edges, and edges by confidence."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("metric"), "n")
    by = edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edges:"), "confidence").alias("metric"), "n")
    return n.unionByName(by).unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("metric"), "n"))


def repo_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("kind").alias("n_kinds"))


def group_of(repo: Column, depth: int) -> Column:
    """The first ``depth`` path segments of a longer id."""
    return F.when(F.size(F.split(repo, "/")) > depth, F.substring_index(repo, "/", depth)).otherwise("(ungrouped)")


def fleet_overview(nodes: DataFrame, depth: int = 1) -> DataFrame:
    real = nodes.where(is_real_repo(F.col("repo_id")))
    return real.groupBy(group_of(F.col("repo_id"), depth).alias("grp")).agg(F.count_distinct("repo_id").alias("n_repos"), F.count(F.lit(1)).alias("n_nodes"))


def distinct_degree(edges: DataFrame) -> DataFrame:
    """Degree of each node; relations with an edge for each site count distinct pairs, others rows."""
    site = F.col("relation").isin(PER_SITE)
    rows = edges.where(~site).select("src", "dst").union(edges.where(site).select("src", "dst", "relation").distinct().select("src", "dst"))
    ends = rows.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("o").alias("n_out"), F.sum(1 - F.col("o")).alias("n_in"))


def top(rows: DataFrame, by: str, n: int, key: str = "node_id") -> DataFrame:
    return rows.orderBy(F.desc(by), key).limit(n)


def kind_floor_topk(rows: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` best by n; kinds that miss get a slot each, at most cap // 2 of them, and the tail makes room."""
    # The best ``cap`` rows and the best row of each kind decide; both are found by partial aggregates or a top-k.
    head = rows.orderBy(F.desc("n"), "node_id").limit(cap).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "node_id")))
    best = rows.groupBy("kind").agg(F.min(F.struct((-F.col("n")).alias("m"), "node_id")).alias("b")).select("kind", (-F.col("b.m")).alias("n"), F.col("b.node_id").alias("node_id"))
    missing = best.join(F.broadcast(head.select("kind").distinct()), "kind", "left_anti").orderBy(F.desc("n"), "node_id").limit(cap // 2)
    slots = missing.agg(F.count(F.lit(1)).alias("slots"))
    kept = head.join(F.broadcast(slots)).where(F.col("rank") <= cap - F.col("slots")).select("node_id", "kind", "n", F.lit("head").alias("slot"))
    return kept.unionByName(missing.select("node_id", "kind", "n", F.lit("floor").alias("slot")))


def fair_floors(histogram: dict[str, int], total: int) -> dict[str, int]:
    """Max-min fair shares of ``total`` slots over kinds: the smallest kinds are filled first, the rest is shared evenly."""
    out, left = {}, total
    kinds = sorted(histogram.items(), key=lambda x: (x[1], x[0]))
    for i, (kind, n) in enumerate(kinds):
        out[kind] = min(n, left // (len(kinds) - i))
        left -= out[kind]
    return out


def floors_of(rows: DataFrame, total: int) -> DataFrame:
    """(kind, floor): max-min fair shares of ``total`` slots over the kinds of ``rows``; the driver holds one count for each kind."""
    shares = fair_floors({r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}, total)
    return rows.sparkSession.createDataFrame(sorted(shares.items()), "kind string, floor int")


def evict_tail(rows: DataFrame, floors: DataFrame, cap: int, salts: int = 64) -> DataFrame:
    """The ``cap`` best by degree, where each kind keeps its best rows up to its floor.  The best of a kind are found among the best of its salts, so
    a kind that holds most rows is spread over tasks."""
    order = (F.desc("degree"), "node_id")
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("node_id"), F.lit(salts)))
    first = salted.withColumn("_w", F.row_number().over(Window.partitionBy("kind", "_s").orderBy(*order))).where(F.col("_w") <= cap)
    marked = first.withColumn("_w", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_w") <= cap)
    marked = marked.join(F.broadcast(floors), "kind", "left").withColumn("_p", F.coalesce(F.col("_w") <= F.col("floor"), F.lit(False)))
    return marked.orderBy(F.desc("_p"), *order).limit(cap).select("node_id", "kind", "degree")


def module_counts(nodes: DataFrame, depth: int, least: int) -> DataFrame:
    deep = nodes.where(F.size(F.split("file", "/")) > depth)
    return deep.groupBy(F.substring_index("file", "/", depth).alias("module")).agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= least)


def load_bearing(uses: DataFrame, sites: int = 3, files: int = 2) -> DataFrame:
    """Values used at several places in several files, ambiguous uses left out."""
    return uses.where(F.col("confidence") != "AMBIGUOUS").groupBy("name").agg(F.count(F.lit(1)).alias("n_sites"), F.count_distinct("file").alias("n_files")).where((F.col("n_sites") >= sites) & (F.col("n_files") >= files))


# ---- repository graph


def c4_edges(repo_edges: DataFrame, depth: int = 1) -> DataFrame:
    """Summed weights between namespaces; a boundary edge joins two of them."""
    ns = lambda c: F.substring_index(F.col(c), "/", depth)
    rows = repo_edges.select(ns("src_repo").alias("src_ns"), ns("dst_repo").alias("dst_ns"), "weight")
    return rows.groupBy("src_ns", "dst_ns").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_edges")).withColumn("boundary", F.col("src_ns") != F.col("dst_ns"))


def split_cluster(repo_edges: DataFrame, namespace: str) -> DataFrame:
    """Edges with both ends in the namespace (internal) or one (boundary)."""
    inside = lambda c: (F.col(c) == namespace) | F.col(c).startswith(namespace + "/")
    n = inside("src_repo").cast("int") + inside("dst_repo").cast("int")
    return repo_edges.withColumn("_n", n).where("_n > 0").withColumn("side", F.when(F.col("_n") == 2, "internal").otherwise("boundary")).drop("_n")


def leakiest(repo_edges: DataFrame, namespace: str, n: int = 5) -> DataFrame:
    """Members of the namespace by the boundary edges that touch them."""
    rows = split_cluster(repo_edges, namespace).where("side = 'boundary'").select(F.explode(F.array("src_repo", "dst_repo")).alias("repo"))
    own = rows.where((F.col("repo") == namespace) | F.col("repo").startswith(namespace + "/"))
    return own.groupBy("repo").agg(F.count(F.lit(1)).alias("touches")).orderBy(F.desc("touches"), "repo").limit(n)


def overview_rank(repo_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Repositories by weighted degree, size and id, with the kind most of their nodes have."""
    w = repo_edges.select(F.explode(F.array("src_repo", "dst_repo")).alias("repo_id"), "weight").groupBy("repo_id").agg(F.sum("weight").alias("weight"))
    by_kind = nodes.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    size = by_kind.groupBy("repo_id").agg(F.sum("n").alias("n_nodes"), F.min(F.struct((-F.col("n")).alias("m"), "kind")).alias("b"))
    return size.join(w, "repo_id").select("repo_id", "weight", "n_nodes", F.col("b.kind").alias("main_kind"))


def relationships(repo_edges: DataFrame) -> DataFrame:
    """Each repository's summed weights out and in, in one scan of the edges."""
    ends = F.explode(F.array(F.struct(F.col("src_repo").alias("repo"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("dst_repo").alias("repo"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i"))))
    return repo_edges.select(ends.alias("e")).select("e.*").groupBy("repo").agg(F.sum("o").alias("weight_out"), F.sum("i").alias("weight_in"))


def repo_table(nodes: DataFrame) -> DataFrame:
    """(repo_id, host, n_nodes, langs) of the real repositories: the first part of the id as the host, languages as lang=n, the most frequent first."""
    by = nodes.where(is_real_repo(F.col("repo_id"))).groupBy("repo_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang")), lambda x: x["lang"].isNotNull())), lambda x: F.concat_ws("=", x["lang"], (-x["m"]).cast("string"))), ",")
    return by.groupBy("repo_id").agg(F.sum("n").cast("long").alias("n_nodes"), told.alias("langs")).select("repo_id", F.substring_index("repo_id", "/", 1).alias("host"), "n_nodes", "langs")


def partitions(nodes: DataFrame) -> DataFrame:
    """(repo_id, kind, of): every partition there is, what kind it is (repository, sentinel, connect, enrich), and the repository it belongs to."""
    r = F.col("repo_id")
    kind = F.when(r.startswith("("), "sentinel").when(r.startswith("@"), F.regexp_extract(r, "^@([a-z]+):", 1)).otherwise("repository")
    of = F.when(r.startswith("("), None).otherwise(F.regexp_replace(r, "^@[a-z]+:", ""))
    return nodes.select("repo_id").distinct().select("repo_id", kind.alias("kind"), of.alias("of"))


def repos_of_patterns(repos: DataFrame, patterns: list[str]) -> DataFrame:
    """Repositories (repo_id, path) that any pattern means: a glob over ids, or, if it begins with / . or ~, over the ends of local paths."""
    keep = F.lit(False)
    for p in patterns:
        local = p[:1] in "/.~"
        bare = re.sub(r"^(~|\.{1,2})?/", "", p) if local else p
        keep = keep | (F.col("path").rlike(glob_pattern("*/" + bare) + "|" + glob_pattern("/" + bare)) if local else F.col("repo_id").rlike(glob_pattern(bare)))
    return repos.where(keep)


def language_map(nodes: DataFrame, depth: int = 1) -> DataFrame:
    """(grp, lang, n_nodes) of the real repositories' groups."""
    real = nodes.where(is_real_repo(F.col("repo_id")) & F.col("lang").isNotNull())
    return real.groupBy(group_of(F.col("repo_id"), depth).alias("grp"), "lang").agg(F.count(F.lit(1)).alias("n_nodes"))


def ranked_overview(repo_edges: DataFrame, nodes: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` of the overview with their rank."""
    order = (F.desc("weight"), F.desc("n_nodes"), "repo_id")
    return overview_rank(repo_edges, nodes).orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def c4_flavours(edges: DataFrame, depth: int = 1, included: list[str] | None = None) -> DataFrame:
    """Summed weights between namespaces for each flavour of edges (src_repo, dst_repo, weight, flavour); with ``included`` only edges that touch one of these namespaces."""
    ns = lambda c: F.substring_index(F.col(c), "/", depth)
    rows = edges.select(ns("src_repo").alias("src_ns"), ns("dst_repo").alias("dst_ns"), "weight", "flavour")
    rows = rows.where(F.col("src_ns").isin(included) | F.col("dst_ns").isin(included)) if included is not None else rows
    return rows.groupBy("flavour", "src_ns", "dst_ns").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_edges"))


def system_context(calls: DataFrame, depth: int = 1) -> DataFrame:
    """(ns, system, n_calls): the outermost view: namespaces and the external systems (hosts) that their repositories call (repo, host, n_calls)."""
    return calls.groupBy(F.substring_index("repo", "/", depth).alias("ns"), F.col("host").alias("system")).agg(F.sum("n_calls").cast("long").alias("n_calls"))


#: The fewest and the most rows that a list may be asked for.
FEWEST, MOST = 1, 500


def clamped(limit: int) -> int:
    return max(FEWEST, min(MOST, limit))


def listing(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """At most ``limit`` rows in order, no more than the ceiling and one at least, with the total and whether some were cut."""
    return budget(rows, clamped(limit), *order)


def seed_ids(nodes: DataFrame, ids: list[str] | None = None, names: list[str] | None = None, query: str | None = None, limit: int = 20) -> DataFrame:
    """(node_id): where a view starts: ids that are nodes, else nodes of these names, else the first of a search; at most ``limit``."""
    if ids:
        return nodes.where(F.col("node_id").isin(ids)).select("node_id").distinct().orderBy("node_id").limit(limit)
    if names:
        return nodes.where(F.col("name").isin(names)).select("node_id").distinct().orderBy("node_id").limit(limit)
    return search.fts_bm25(nodes, query or "", limit).select("node_id") if query and search.query_terms(query) else nodes.limit(0).select("node_id")
