"""One front door: a question is routed to the operator that can answer it, and what the graph has proved, also that there is nothing, is told with the answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fleet, graph, search, traverse


@dataclass
class Answer:
    """What ``ask`` returns: rows are a bounded DataFrame whose columns depend on the route; established is a fact that holds whatever the rows are."""

    question: str
    route: str
    target: str | None
    rows: DataFrame
    note: str | None = None
    established: str | None = None


def classify(spark, question: str) -> tuple[str, str | None]:
    """(route, target) by the same expressions that route a column of questions."""
    q = F.lit(question)
    row = spark.range(1).select(fleet.route(q).alias("route"), fleet.target_of(q).alias("target")).first()
    return row["route"], row["target"]


def chosen_one_of(name: str, n: int) -> str | None:
    return f"{n} match {name}; the first is used" if n > 1 else None


def resolve(nodes: DataFrame, name: str | None, repo: str | None = None) -> tuple[str | None, str | None]:
    """(node_id, note): the node a question means, by id, then by name; why there is none, or that others were passed over."""
    if not name:
        return None, "no symbol found in the question"
    if nodes.where(F.col("node_id") == name).limit(1).count():
        return name, None
    own = nodes.where(F.col("repo_id") == repo) if repo else nodes
    hits = graph.resolve_target(own.where(F.col("name") == name), name).collect()
    if not hits:
        return None, f"no indexed symbol named {name}"
    return hits[0]["node_id"], chosen_one_of(name, len(hits))


def resolve_repo(nodes: DataFrame, name: str | None) -> tuple[str | None, str | None]:
    """(repo_id, note): by the whole id, then by its last path segment."""
    if not name:
        return None, "no repository named in the question"
    hits = nodes.select("repo_id").distinct().where((F.col("repo_id") == name) | (F.substring_index("repo_id", "/", -1) == name)).orderBy(F.desc(F.col("repo_id") == name), "repo_id").limit(20).collect()
    if not hits:
        return None, f"no indexed repository matches {name}"
    return hits[0]["repo_id"], chosen_one_of(name, len(hits))


def ask(nodes: DataFrame, edges: DataFrame, question: str, k: int = 8, repo: str | None = None, commits: DataFrame | None = None, pages: DataFrame | None = None) -> Answer:
    """Routes ``question`` and answers it.  A route that finds nothing falls back to a search, keeps its own name, and tells what it has established."""
    route, target = classify(nodes.sparkSession, question)
    note = established = None

    def answer(rows: DataFrame, extra: str | None = None) -> Answer:
        return Answer(question, route, target, rows, "; ".join(x for x in (note, extra) if x) or None, established)

    if route == "definition" and target:
        found = graph.nodes_by_name(nodes, target, repo=repo)
        if found.limit(1).count():
            return answer(found.orderBy("node_id").limit(k))
        established = graph.miss_note(nodes, target, repo=repo)
    elif route in ("callers", "impact", "subclasses", "dependents"):
        node, note = resolve(nodes, target, repo)
        if node is None:
            established = note
            note = None
        elif route == "callers":
            return answer(graph.call_sites(nodes, edges, node, callers=True).orderBy("conf_rank", "node_id", "source_line").limit(k))
        elif route == "impact":
            seed = nodes.sparkSession.createDataFrame([(node,)], "node_id string")
            return answer(traverse.blast_radius(edges, seed, nodes=nodes).orderBy("hop", "node_id"))
        else:
            at = nodes.where(F.col("node_id") == node)
            found = graph.sources_of(nodes, edges, at, "inherits" if route == "subclasses" else "depends_on")
            return answer(found.orderBy("node_id").limit(k))
    elif route == "owners":
        own, note = resolve_repo(nodes, target)
        if own is not None and commits is not None:
            return answer(fleet.owners(commits.where(F.col("repo_id") == own)).orderBy(F.desc("score"), "author").limit(k))
        established, note = note, None
    elif route == "explain" and pages is not None:
        own, note = resolve_repo(nodes, target)
        page = pages.where(F.col("repo_id") == own) if own else None
        if page is not None and page.limit(1).count():
            return answer(page, "advisory prose, not a fact of the graph")
        established, note = note or f"nothing is written about {own}", None
    return answer(*search_with_floor(nodes, question, k))


def impact_with_candidates(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(hits, others): the impact of what a name means, and the definitions of that name that were passed over, best first."""
    node, _ = resolve(nodes, name)
    others = graph.resolve_target(nodes.where(F.col("name") == name), name).where(F.col("node_id") != node) if node else nodes.limit(0)
    seed = nodes.sparkSession.createDataFrame([(node,)] if node else [], "node_id string")
    return traverse.blast_radius(edges, seed, nodes=nodes), others


def path_with_candidates(nodes: DataFrame, edges: DataFrame, start: str, end: str, hops: int = 6) -> tuple[DataFrame, str | None]:
    """(steps, note): the cited path between what two names mean; or why there is none."""
    (a, why_a), (b, why_b) = resolve(nodes, start), resolve(nodes, end)
    none = nodes.sparkSession.createDataFrame([], "step int, from_id string, to_id string, relation string, confidence string, line int, forward boolean")
    if a is None or b is None:
        return none, why_a if a is None else why_b
    path = traverse.shortest_path(edges, a, b, hops)
    return traverse.path_citations(edges, path), traverse.path_gap(path, start, end, hops) or why_a or why_b


def search_with_floor(nodes: DataFrame, question: str, k: int = 8, repos: DataFrame | None = None) -> tuple[DataFrame, str | None]:
    """(hits, note): nodes, of the scope of ``repos`` (repo_id) if given, found by the question's own words, any of them; nothing, and why, where none of the words is in the graph."""
    spark = nodes.sparkSession
    terms = [t for t in spark.range(1).select(fleet.content_terms(F.lit(question)).alias("t")).first()["t"]]
    hits = search.fts_any(graph.in_scope(nodes, repos), terms, k)
    if not terms:
        return hits, "the question holds no word to look for"
    if not hits.limit(1).count():
        return hits, f"nothing in the graph mentions {', '.join(terms)}"
    return hits, None


def hydrate(hits: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(rows, dropped): hits (node_id, score) with their nodes; stale ones, which have none any more, are counted."""
    both = hits.join(nodes.select("node_id", "repo_id", "kind", "name", "file", "line_start"), "node_id", "left")
    return both.where(F.col("name").isNotNull()), both.where(F.col("name").isNull()).count()


def vector_tool(vectors: DataFrame, nodes: DataFrame, query: list[float] | None, k: int = 10, floor: float = 0.0, edges: DataFrame | None = None) -> tuple[DataFrame, str | None]:
    """(rows, note) of a semantic search, or of a hybrid one if edges are given: an empty query and an unpopulated store are told, hits below the floor and stale ones are left out."""
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "node_id long, score double")
    if not query:
        return none, "empty query"
    if not vectors.limit(1).count():
        return none, "no vectors are stored; embed the repository first"
    hits = search.vector_topk(vectors, query, k).withColumnRenamed("vec_id", "node_id") if edges is None else search.hybrid(vectors, edges, query, k)
    rows, dropped = hydrate(hits.where(F.col("score") >= floor), nodes)
    return rows, f"{dropped} stale hits were dropped" if dropped else None


# ---- retrieval for evaluation


def load_golden(rows: list[dict]) -> list[dict]:
    """Golden queries that can be scored; any that can't is an error that names it."""
    for i, r in enumerate(rows):
        if not str(r.get("query") or "").strip():
            raise ValueError(f"golden row {i} has no query")
        expected = r.get("expected")
        if not isinstance(expected, list) or not expected or not all(isinstance(x, str) and x for x in expected):
            raise ValueError(f"golden row {i} expects nothing")
        if r.get("match", "name") not in ("name", "id"):
            raise ValueError(f"golden row {i} matches by {r['match']}, which is neither name nor id")
    return [{"query": r["query"], "expected": r["expected"], "match": r.get("match", "name"), "kind": r.get("kind")} for r in rows]


def fts_retriever(nodes: DataFrame, k: int = 10):
    """A function from a query to (rank, node_id)."""
    def run(query: str) -> DataFrame:
        return _ranked(search.fts(nodes, query, k), ["exact", "prefix", "score"])

    return run


def semantic_retriever(vectors: DataFrame, embed, k: int = 10):
    def run(query: str) -> DataFrame:
        return _ranked(search.vector_topk(vectors, embed(query), k).withColumnRenamed("vec_id", "node_id"), ["score"])

    return run


def hybrid_retriever(vectors: DataFrame, edges: DataFrame, embed, k: int = 10):
    def run(query: str) -> DataFrame:
        return _ranked(search.hybrid(vectors, edges, embed(query), k), ["score"])

    return run


def _ranked(hits: DataFrame, by: list[str]) -> DataFrame:
    from pyspark.sql import Window

    order = Window.orderBy(*[F.desc(c) for c in by], "node_id")  # at most k rows
    return hits.select(F.row_number().over(order).alias("rank"), "node_id")
