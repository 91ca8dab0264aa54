"""The engine's tools under their public names, on one graph: every answer is a bounded DataFrame, with what must be told about it beside it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ask as front
from .operators import fleet, graph, health, links, search, traverse


@dataclass
class Result:
    """Rows, and a note where there is something to say: that some were cut, or why there are none."""

    rows: DataFrame
    note: str | None = None


@dataclass
class Tools:
    """A graph (nodes, edges) and what else a deployment has: repositories' heads, commits, documents by kind (wiki, generated, fleet, readme), flows between repositories, vectors and an embedder."""

    nodes: DataFrame
    edges: DataFrame
    repos: DataFrame | None = None
    commits: DataFrame | None = None
    documents: DataFrame | None = None
    http: tuple[DataFrame, DataFrame] | None = None
    events: tuple[DataFrame, DataFrame] | None = None
    vectors: DataFrame | None = None
    near: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    parser: str = "1"
    limit: int = field(default=100)

    def _listed(self, rows: DataFrame, limit: int | None, *order) -> Result:
        n = graph.clamped(limit or self.limit)
        out = rows.orderBy(*order).limit(n + 1)
        more = out.count() > n
        return Result(out.limit(n), f"more than {n}; narrow the question" if more else None)

    def _missing(self, what: str) -> Result:
        return Result(self.nodes.limit(0), f"no {what} here")

    # -- lookups

    def graph_stats(self) -> Result:
        return Result(graph.stats(self.nodes, self.edges))

    def get_node(self, node_id: str) -> Result:
        return Result(links.project_nodes(graph.get_node(self.nodes, node_id)))

    def get_neighbors(self, node_id: str, direction: str = "both", relation: str | None = None, limit: int | None = None) -> Result:
        return self._listed(links.project_edges(graph.neighbors(self.edges, node_id, direction, relation)), limit, "conf_rank", "src", "dst", "relation", "line")

    def search_code(self, query: str, limit: int | None = None, repo: str | None = None) -> Result:
        rows, note = front.search_with_floor(self.nodes.where(F.col("repo_id") == repo) if repo else self.nodes, query, graph.clamped(limit or 10))
        return Result(rows, note)

    def find_definition(self, name: str, kind: str | None = None, repo: str | None = None, limit: int | None = None) -> Result:
        out = self._listed(graph.nodes_by_name(self.nodes, name, kind, repo), limit, "node_id")
        return Result(links.project_nodes(out.rows), out.note or graph.miss_note(self.nodes, name, kind, repo))

    def list_repos(self, limit: int | None = None) -> Result:
        return self._listed(graph.repo_table(self.nodes), limit, "repo_id")

    # -- uses and impact

    def _sites(self, name: str, callers: bool, limit: int | None) -> Result:
        node, note = front.resolve(self.nodes, name)
        if node is None:
            return self._missing(note or name)
        out = self._listed(graph.call_sites(self.nodes, self.edges, node, callers), limit, "conf_rank", "node_id", "source_line")
        return Result(out.rows, "; ".join(x for x in (note, out.note) if x) or None)

    def find_callers(self, name: str, limit: int | None = None) -> Result:
        return self._sites(name, True, limit)

    def find_callees(self, name: str, limit: int | None = None) -> Result:
        return self._sites(name, False, limit)

    def find_dependents(self, name: str, limit: int | None = None) -> Result:
        return self._listed(graph.sources_of(self.nodes, self.edges, self.nodes.where(F.col("name") == name), "depends_on"), limit, "node_id")

    def blast_radius(self, name: str, hops: int = traverse.HOPS, limit: int = traverse.HITS) -> Result:
        node, note = front.resolve(self.nodes, name)
        if node is None:
            return self._missing(note or name)
        seed = self.nodes.sparkSession.createDataFrame([(node,)], "node_id string")
        return Result(traverse.blast_radius(self.edges, seed, min(hops, traverse.HOPS), limit=min(limit, traverse.HITS), nodes=self.nodes), note)

    def shortest_path(self, start: str, end: str, hops: int = 6) -> Result:
        return Result(*front.path_with_candidates(self.nodes, self.edges, start, end, min(hops, 6)))

    # -- repositories

    def repo_dependencies(self, limit: int | None = None) -> Result:
        return self._listed(graph.repo_dependencies(self.nodes, self.edges), limit, F.desc("weight"), "src_repo", "dst_repo")

    def repo_flow(self, limit: int | None = None) -> Result:
        return self._listed(graph.two_hop(*self.http, "endpoint", "repo", "repo"), limit, F.desc("weight"), "src_repo", "dst_repo") if self.http else self._missing("endpoints")

    def repo_event_flow(self, limit: int | None = None) -> Result:
        return self._listed(graph.two_hop(*self.events, "topic", "repo", "repo"), limit, F.desc("weight"), "src_repo", "dst_repo") if self.events else self._missing("topics")

    def who_knows(self, repo: str, limit: int | None = None) -> Result:
        own, note = front.resolve_repo(self.nodes, repo)
        if own is None or self.commits is None:
            return self._missing(note or "history")
        return Result(self._listed(fleet.owner_table(self.commits.where(F.col("repo_id") == own)), limit, F.desc("score"), "author").rows, note)

    def get_repo_brief(self, repo: str) -> Result:
        own, note = front.resolve_repo(self.nodes, repo)
        if own is None:
            return self._missing(note or repo)
        return Result(health.repo_brief(self.nodes.where(F.col("repo_id") == own), self.edges.where(F.col("repo_id") == own)), note)

    def get_repo_links(self, repo: str) -> Result:
        return Result(links.external_links(self.nodes, self.edges, F.col("src") == f"repo_{repo}"))

    def graph_health(self) -> Result:
        return Result(health.graph_health(self.repos, self.nodes, self.edges, self.parser)) if self.repos is not None else self._missing("repository states")

    # -- documents

    def _document(self, kind: str, key: str | None) -> Result:
        if self.documents is None:
            return self._missing("documents")
        rows = self.documents.where(F.col("kind") == kind)
        rows = rows.where(F.col("key") == key) if key is not None else rows
        found = rows.limit(1).count()
        return Result(rows, ("advisory prose, not a fact of the graph" if kind == "wiki" else None) if found else f"no {kind} document of {key or 'the fleet'}")

    def get_wiki(self, repo: str) -> Result:
        return self._document("wiki", repo)

    def get_generated_doc(self, repo: str) -> Result:
        return self._document("generated", repo)

    def get_fleet_doc(self) -> Result:
        return self._document("fleet", None)

    def get_readme(self, repo: str) -> Result:
        return self._document("readme", repo)

    # -- retrieval

    def semantic_search(self, query: str, k: int = 10, floor: float = 0.0) -> Result:
        if self.vectors is None or self.embed is None:
            return self._missing("vectors")
        return Result(*front.vector_tool(self.vectors, self.nodes, self.embed(query) if query.strip() else None, k, floor))

    def hybrid_search(self, query: str, k: int = 10) -> Result:
        if self.vectors is None or self.embed is None or self.near is None:
            return self._missing("vectors")
        return Result(*front.vector_tool(self.vectors, self.nodes, self.embed(query) if query.strip() else None, k, edges=self.near))

    def ask(self, question: str, k: int = 8, repo: str | None = None) -> front.Answer:
        pages = self.documents.where("kind = 'wiki'").withColumnRenamed("key", "repo_id") if self.documents is not None else None
        return front.ask(self.nodes, self.edges, question, k, repo, self.commits, pages)


#: The public names.
NAMES = [n for n in vars(Tools) if not n.startswith("_") and callable(getattr(Tools, n))]
