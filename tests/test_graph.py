import math
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from weftgraph import catalog
from weftgraph.functions import chunk, ids
from weftgraph.operators import fleet, graph, health, render, search, text, traverse
from weftgraph.plans import view, work
from weftgraph.sources import files, shards, web
from weftgraph.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", ["graph_stats", "repo_dependencies", "http_flow", "external_systems", "distinct_degree", "kind_floor_topk", "name_resolution", "blast_radius", "bm25_search", "knn_graph", "eval_metrics", "owners_decay", "ngram_leak", "citation_check", "render_mermaid"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    key = lambda r: tuple(map(str, r))
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(want.project(",".join(f'"{c}"' for c in columns)).fetchall(), key=key)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


CALLS = [("A", "S", "calls", "EXTRACTED"), ("B", "A", "calls", "INFERRED"), ("C", "B", "calls", "EXTRACTED"), ("C", "A", "calls", "AMBIGUOUS"), ("S", "S", "calls", "EXTRACTED")]


def test_blast_radius_and_paths(spark):
    e = frame(spark, CALLS, "src string, dst string, relation string, confidence string")
    got = {(r["node_id"], r["hop"], r["via"]) for r in traverse.blast_radius(e, frame(spark, [("S",)], "node_id string")).collect()}
    assert got == {("A", 1, "S"), ("B", 2, "A"), ("C", 2, "A")}
    assert [r["node_id"] for r in traverse.shortest_path(e, "S", "B").orderBy("step").collect()] == ["S", "A", "B"]
    assert traverse.shortest_path(e, "S", "Z").count() == 0
    assert graph.neighbors(e, "S").count() == 2
    with pytest.raises(ValueError):
        graph.neighbors(e, "S", "sideways")


def test_per_site_edges_count_once(spark):
    e = frame(spark, [("a", "b", "calls", 1), ("a", "b", "calls", 2), ("a", "b", "contains", 3), ("a", "b", "contains", 4)], "src string, dst string, relation string, source_line int")
    assert {r["node_id"]: r["degree"] for r in graph.distinct_degree(e).collect()} == {"a": 3, "b": 3}


def test_floors():
    assert graph.fair_floors({"a": 1, "b": 100, "c": 100}, 11) == {"a": 1, "b": 5, "c": 5}
    assert graph.fair_floors({}, 5) == {}


def test_search_ranking(spark):
    names = ["Context", "ContextMeta", "test_context_meta", "test_context_basic", "context_helper"]
    n = frame(spark, [(str(i), x, "src/core.py") for i, x in enumerate(names)], "node_id string, name string, file string")
    for q in ("Context", "context"):
        assert search.fts(n, q).first()["name"] == "Context"
    assert search.fts(n, "context meta").first()["name"] in ("ContextMeta", "test_context_meta")
    assert [r["name"] for r in search.fts(n, "context").collect()][:3] == ["Context", "ContextMeta", "context_helper"]


def test_hybrid(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    e = frame(spark, [(1, 2)], "src long, dst long")
    assert [r["node_id"] for r in search.hybrid(v, e, [1.0, 0.0], k=3).collect()] == [1, 2, 3]
    assert [tuple(r) for r in search.collapse_chunks(frame(spark, [("a", 0.1), ("a", 0.9), ("b", 0.5)], "node_id string, score double"), 2).collect()] == [("a", 0.9), ("b", 0.5)]


@pytest.mark.parametrize("body", ["short", "word " * 900, "x" * 5000, "para one\n\n" + "y " * 2000 + "\n\nlast", "", "  \n\n "])
def test_chunks_lose_nothing(body):
    parts = chunk.split_document(body)
    assert all(len(p) <= 1200 for p in parts)
    assert sum(len(p.replace(" ", "").replace("\n", "")) for p in parts) >= len(body.replace(" ", "").replace("\n", ""))
    if body.strip():
        assert parts[-1].rstrip().endswith(body.strip()[-3:])


def test_ids(spark):
    assert ids.normalize_text("Ａb--C_ ﬁ") == "ab_c_fi" and ids.normalize_text(ids.normalize_text("ẞ İ")) == ids.normalize_text("ẞ İ")
    from pyspark.sql import functions as F

    r = frame(spark, [("git@Host.org:Team/Repo.git", "https://me@host.org/Team/Repo.git/", None)], "a string, b string, c string").select(
        ids.remote_key(F.col("a")).alias("a"), ids.remote_key(F.col("b")).alias("b"), ids.symbol_id(F.lit("s"), F.lit("x"), F.col("c")).alias("c")
    ).first()
    assert r["a"] == r["b"] == "host.org/team/repo" and r["c"] == ids.symbol_id_of("s", "x", None)


def test_fleet_counts_repositories(spark):
    rows = [("p", "r1", "m1", "1"), ("p", "r1", "m2", "1"), ("q", "r1", "m1", None), ("q", "r2", "m1", "2")]
    got = {r["package"]: (r["n_repos"], r["shared"], r["disagreeing"]) for r in fleet.commitments(frame(spark, rows, "package string, repo string, manifest string, constraint string")).collect()}
    assert got == {"p": (1, False, False), "q": (2, True, True)}


ROUTED = [("who calls parse_source?", "callers", "parse_source"), ("what breaks if I change `GraphStore`?", "impact", "GraphStore"), ("who owns the parser", "owners", "parser"), ("subclasses of BaseSource", "subclasses", "BaseSource"), ("what depends on requests", "dependents", "requests"), ("where is read_shard defined", "definition", "read_shard"), ("explain HybridSearch", "explain", "HybridSearch"), ("vector index", "search", "index")]


def test_router(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, [r[:1] for r in ROUTED], "q string").select("q", fleet.route(F.col("q")).alias("route"), fleet.target_of(F.col("q")).alias("target")).collect()
    assert [tuple(r) for r in rows] == ROUTED


def test_text_helpers(spark):
    from pyspark.sql import functions as F

    r = frame(spark, [("a\x00b\tc", "https://x.org/users/123/:id?q=1", "uses svc-a and svc-ab")], "a string, u string, t string").select(
        text.sanitize_label(F.col("a")).alias("a"), text.normalize_path(F.col("u")).alias("p"), text.redact(F.col("t"), ["svc-a", "svc-ab"]).alias("t"), text.untrusted_block(F.col("t")).alias("b")
    ).first()
    assert r["a"] == "ab\tc" and r["p"] == "/users/{}/{}" and "svc-" not in r["t"] and r["b"].startswith("<<<untrusted ")


def test_web():
    title, body = web.html_to_text("<html><head><title> T </title><style>x</style></head><body><p>a  b</p><script>no</script>c &amp; d</body>")
    assert (title, body) == ("T", "a b\nc & d")
    assert web.next_link('<a?p=1>; rel="prev", <a?p=3>; rel="next"') == "a?p=3" and web.next_link(None) is None
    assert web.dig({"a": [{"b": 1}]}, "a.0.b") == 1 and web.dig({"a": 1}, "a.b") is None
    assert web.has_next_page({"data": {"x": [{"pageInfo": {"hasNextPage": True}}]}})


def test_pages_and_json(spark, sf):
    pages = web.page_texts(spark.read.parquet(f"{sf}/pages.parquet"))
    assert pages.where("text = '' or title = ''").count() < pages.count() and not pages.where("text like '%<script%'").count()
    raw = frame(spark, [('{"data": {"items": [{"id": 1, "a": {"b": "x"}}, {"id": 2}]}}',)], "j string")
    assert [tuple(r) for r in web.json_records(raw, "j", "data.items", {"id": "id", "b": "a.b"}).collect()] == [("1", "x"), ("2", None)]


def test_sources(spark, tmp_path):
    defs, refs = files.parse_ddl("create table a (id int); -- references zz\nCREATE TABLE s.b (x int REFERENCES a(id), y int references b);\ncreate view v as select * from b join a;")
    assert [(d["kind"], d["name"], d["line"]) for d in defs] == [("table", "a", 1), ("table", "b", 2), ("view", "v", 3)]
    assert {(r["src"], r["dst"]) for r in refs} == {("b", "a"), ("v", "b"), ("v", "a")}
    assert files.parse_manifest("pyproject.toml", '[project]\ndependencies = ["numpy>=1.2", "x"]')[0] == {"package": "numpy", "constraint": ">=1.2", "group": "runtime"}
    assert files.parse_manifest("package.json", "{") == []
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/g.py").write_text("# Code generated by x")
    tree = files.read_tree(spark, str(tmp_path))
    assert [r["lang"] for r in files.kept_files(tree, ["node_modules/"]).collect()] == ["python"]


def test_shards_and_snapshots(spark, tmp_path):
    p, h = str(tmp_path / "nodes"), str(tmp_path / "history")
    a, b = frame(spark, [("n1", "r1"), ("n2", "r2")], "node_id string, repo_id string"), frame(spark, [("n3", "r1")], "node_id string, repo_id string")
    shards.write_shard(a, p)
    shards.write_shard(b, p)
    assert {r["node_id"] for r in shards.read_shard(spark, p).collect()} == {"n2", "n3"}
    shards.archive(a, h, "c1")
    shards.archive(b, h, "c2")
    assert [r["node_id"] for r in shards.read_at(spark, h, "r1", "c1").collect()] == ["n1"]
    assert {r["commit"] for r in shards.indexed_commits(spark, h, "r1").collect()} == {"c1", "c2"}
    with pytest.raises(LookupError):
        shards.read_at(spark, h, "r1", "c9")
    shards.forget(spark, [p], "r2")
    assert {r["node_id"] for r in shards.read_shard(spark, p).collect()} == {"n3"}


def test_incremental_stream(spark, tmp_path):
    schema = "repo_id string, head string, parser string, seq long, node_id string"
    put = lambda rows: frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: incremental.index_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    put([("r1", "h1", "10", 1, "a"), ("r2", "h1", "10", 1, "b")])
    run()
    put([("r1", "h2", "10", 2, "c"), ("r2", "h1", "10", 2, "again")])
    run()
    assert {(r["repo_id"], r["node_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("r1", "c"), ("r2", "b")}


def test_windowed_counts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert incremental.windowed_counts(e).groupBy().sum("n").first()[0] == e.count()


def test_rendering_escapes(spark):
    n = frame(spark, [("a", 'x"<y>')], "node_id string, name string")
    e = frame(spark, [("a", "a", "calls")], "src string, dst string, relation string")
    assert '[label="x\\"<y>"]' in render.to_dot(n, e).first()[0]
    assert "x&quot;&lt;y&gt;" in render.to_graphml(n, e).first()[0]
    assert 'MERGE (:Node {id: "a"' in render.to_cypher(n, e).first()[0] and "-[:CALLS]->" in render.to_cypher(n, e).first()[0]


def test_pagerank_keeps_mass(spark):
    from weftgraph.operators import pagerank

    pairs = frame(spark, [(0, 1, 2), (0, 2, 3)], "query_id long, src long, dst long")
    got = pagerank.push(pairs, frame(spark, [(0, 1, 1.0), (0, 9, 0.5)], "query_id long, id long, score double"), tolerance=1e-4).collect()
    r = {x["node_id"]: x["score"] for x in got}
    assert math.isclose(sum(r.values()) + got[0]["residual"], 1.0) and r[1] > r[2] > r[3] and set(r) == {1, 2, 3, 9}


def repeats_of(t, least=12):
    """Sentences and 12-word spans by plain counts, as the reference has them."""
    sentences, spans = [], []
    for line in t.splitlines():
        parts = re.split(r"(?<=[.!?])\s+", line.strip().lstrip("#-*>+ ").strip())
        sentences += [w for w in (tuple(re.findall("[a-z0-9]+", p.lower())) for p in parts) if len(w) >= least]
        w = re.findall("[a-z0-9]+", line.lower())
        spans += [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
    return tuple(max(Counter(x).values(), default=0) for x in (sentences, spans))


def test_repeats_within_lines(spark):
    said = "The same twelve words are written here once more without an end"
    rows = [(1, f"{said}. " * 20), (2, f"{said} " * 20), (3, "\n".join(f"{'-*#>'[i % 4]} {said.upper() if i % 2 else said}!" for i in range(9)))]
    rows += [(4, f"{said}?\u00a0{said}?\u2028{said}?\r\n{said}?"), (5, "\n".join(["- pytest", "- ruff"] * 20)), (6, None), (7, ""), (8, said)]
    got = {r["doc_id"]: (r["n_sentence"], r["n_span"], r["looping"]) for r in text.repeats(frame(spark, rows, "doc_id long, text string")).collect()}
    want = {i: (*repeats_of(t or ""), max(repeats_of(t or "")) > 8) for i, t in rows}
    assert got == want and {i for i in got if got[i][2]} == {1, 2, 3}


def test_repeats_on_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(tuple(r) for r in catalog.QUERIES["repeated_sentence_or_span"](spark, sf).collect())
    assert got == sorted((i, *repeats_of(t), max(repeats_of(t)) > 8) for i, t in docs.items())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.sql(catalog.ORACLE_SQL["repeated_sentence_or_span"]).fetchall())


def test_dependencies_are_counted_where_they_are_joined(spark):
    """A package meets a pair of repositories once, also where several nodes of a repository ask for it; no distinct count keeps the pairs apart."""
    nodes = frame(spark, [("a", "r1"), ("b", "r1"), ("c", "r2"), ("d", "r3")], "node_id string, repo_id string")
    edges = frame(spark, [("a", "p", "depends_on"), ("b", "p", "depends_on"), ("a", "q", "depends_on"), ("c", "p", "publishes"), ("c", "q", "publishes"), ("d", "q", "publishes"), ("a", "q", "publishes"), ("x", "p", "publishes")], "src string, dst string, relation string")
    got = graph.repo_dependencies(nodes, edges)
    assert sorted(map(tuple, got.collect())) == [("r1", "r2", 2), ("r1", "r3", 1)]
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_work_tables_have_tasks_by_rows_and_put_settings_back(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(x, None) for x in names]
    made = work.work_table(frame(spark, [(1, "x"), (2, "y"), (3, "x")], "n int, k string"), "halves", "k", work.tasks_for(spark, 50_000_000))
    assert sorted(map(tuple, made.collect())) == [(1, "x"), (2, "y"), (3, "x")]
    assert [spark.conf.get(x, None) for x in names] == before
    assert work.tasks_for(spark, 50_000_000) == 50 and work.tasks_for(spark, 10) == int(before[0])


def test_dependencies_are_made_without_the_views(spark, sf):
    """Neither the nodes nor the edges are written for them; they are those of the views."""
    own = f"{sf}/."
    got = catalog._deps(spark, own)
    assert {name for _, at, name in view._stored if at == own} == {"dependencies"}
    assert sorted(got.collect()) == sorted(graph.repo_dependencies(view.nodes(spark, sf), view.edges(spark, sf)).collect())
    assert sorted(catalog.overview_rank(spark, own).collect()) == sorted(graph.overview_rank(got, view.nodes(spark, sf)).collect())
    assert {name for _, at, name in view._stored if at == own} == {"dependencies"}


def test_briefs_meet_degrees_once(spark, monkeypatch):
    """The pairs of edges are made and the nodes joined to their degrees once for the three lists, and a package with two nodes counts once."""
    made = []
    monkeypatch.setattr(health, "work_table", lambda df, name, *a, **k: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or work.work_table(df, name, *a, **k))
    nodes = [(f"n{i}", "r1" if i < 30 else "r2", "class" if i % 5 else "function", f"N{i}", f"src/{i % 3}.py" if i % 2 else None, "py") for i in range(50)] + [("p", "(packages)", "package", n, None, None) for n in ("P", "Q")]
    edges = [(f"n{i}", f"n{i * 7 % 50}", "calls", "r1" if i < 30 else "r2") for i in range(50)] + [("n1", "p", "depends_on", "r1"), ("n2", "p", "depends_on", "r1"), ("n40", "p", "publishes", "r2"), ("n41", "p", "depends_on", "r2")]
    out = health.whole_brief(frame(spark, nodes, "node_id string, repo_id string, kind string, name string, file string, lang string"), frame(spark, edges, "src string, dst string, relation string, repo_id string"), 3)
    got = {r["repo_id"]: r.asDict() for r in out.collect()}
    assert [n for n, _ in made].count("degrees") == 1 and not any("relation" in plan for n, plan in made if n in ("best", "ranked"))
    assert (got["r1"]["needed_packages"], got["r1"]["n_needed_packages"], got["r1"]["n_own_packages"]) == ("P,Q", 1, 0)
    assert (got["r2"]["own_packages"], got["r2"]["n_own_packages"], got["r2"]["n_needed_packages"]) == ("P,Q", 1, 0)
    order = sorted(((-sum((s == n[0]) + (d == n[0]) for s, d, *_ in edges), n[0]) for n in nodes if n[1] == "r1"))
    assert len(got["r1"]["top_symbols"].split(",")) == 15 and got["r1"]["top_symbols"].split(",")[:10] == ["N" + x[1:] for _, x in order[:10]]
    assert got["r1"]["coverage_total"] == 15 and got["r1"]["n_files"] == 3 and "package=2" in got["(packages)"]["kinds"]
