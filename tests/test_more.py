import json
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph import catalog_more
from weftgraph.functions import scalars
from weftgraph.operators import ask, embed, fleet, graph, health, links, search, text, traverse, views
from weftgraph.sources import extract, files, shards, sinks, web
from weftgraph.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = sorted(n for n, f in catalog_more.QUERIES.items() if n in catalog_more.ORACLE_SQL and f.__module__ == "weftgraph.catalog_more")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", [*ALL, "resolve_target", "evict_tail", "reverse_reach", "shortest_path", "subgraph_induced", "relevance_floor", "as_of_snapshot", "issue_keys", "link_kinds", "content_terms", "render_graphml", "render_cypher", "dangling_edges", "package_facts"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog_more.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(catalog_more.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    key = lambda r: tuple(map(str, r))
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows and rows == sorted(want.project(",".join(f'"{c}"' for c in columns)).fetchall(), key=key)


GOLDEN = [
    ("where is CatalogService defined", "definition", "CatalogService"), ("definition of charge_order", "definition", "charge_order"), ("who calls charge_order", "callers", "charge_order"), ("what calls PaymentClient", "callers", "PaymentClient"),
    ("callers of validate_token", "callers", "validate_token"), ("who uses the auth-service", "callers", "auth-service"), ("what depends on requests", "dependents", "requests"), ("which repos use shared-core", "dependents", "shared-core"),
    ("dependents of the payments package", "dependents", "payments"), ("what extends BaseController", "subclasses", "BaseController"), ("subclasses of Embedder", "subclasses", "Embedder"), ("who implements Store", "subclasses", "Store"),
    ("implementations of PaymentGateway", "subclasses", "PaymentGateway"), ("classes that extend BaseView", "subclasses", "BaseView"), ("what breaks if I change CatalogService", "impact", "CatalogService"), ("blast radius of charge_order", "impact", "charge_order"),
    ("is it safe to remove LegacyAdapter", "impact", "LegacyAdapter"), ("impact of modifying the billing module", "impact", "billing"), ("who owns the catalog-api", "owners", "catalog-api"), ("who knows about payment-gateway", "owners", "payment-gateway"),
    ("who is the SME for billing-api", "owners", "billing-api"), ("explain the order-service architecture", "explain", "order-service"), ("how does CatalogService work", "explain", "CatalogService"), ("what is the billing-service", "explain", "billing-service"),
    ("give me an overview of auth-service", "explain", "auth-service"), ("where do we validate the tenant header", "search", None), ("find the code that parses ISO timestamps", "search", None), ("logic for refunding a payment", "search", None),
    ("Who calls classify? List every caller.", "callers", "classify"), ("what is `the thing` in Foo.bar", "explain", "the thing"), ("", "search", None),
]


def test_router_golden(spark):
    rows = frame(spark, [(q,) for q, _, _ in GOLDEN], "q string").select("q", fleet.route(F.col("q")).alias("r"), fleet.target_of(F.col("q")).alias("t")).collect()
    for (q, route, target), row in zip(GOLDEN, rows):
        assert row["r"] == route and (target is None or row["t"] == target), (q, row)


def test_content_terms_keep_case_and_order(spark):
    got = frame(spark, [("Retry the retry of HttpClient, httpclient or IO",)], "q string").select(fleet.content_terms(F.col("q")).alias("t")).first()["t"]
    assert got == ["Retry", "HttpClient"]


# ---- resolution


def test_references_prefer_language_and_linkage(spark):
    defs = frame(spark, [("py", "close", "function", "python", "a.py", False), ("js", "close", "function", "javascript", "b.js", False), ("ts", "close", "function", "typescript", "c.ts", False), ("s1", "gate", "function", "c", "x.c", True), ("s2", "gate", "function", "c", "y.c", True), ("h", "inl", "function", "cpp", "z.h", True),
                         *[(f"m{i}", "many", "function", "go", f"{i}.go", False) for i in range(7)], ("k", "close", "table", None, "t.sql", False)], "node_id string, name string, kind string, lang string, file string, internal boolean")
    refs = frame(spark, [("u", "close", "python", "u.py", 3), ("u", "close", "python", "u.py", 1), ("v", "close", "javascript", "v.js", 1), ("w", "gate", "c", "x.c", 1), ("w2", "gate", "c", "other.c", 1), ("w3", "inl", "c", "q.c", 1), ("g", "many", "go", "g.go", 1), ("n", "close", None, "n", 1), ("py", "close", "python", "a.py", 9)], "src string, name string, lang string, file string, line int")
    edges, counts = graph.resolve_references(refs, defs, "calls", ["function"])
    got = {(r["src"], r["dst"], r["confidence"], r["candidates"], r["line"]) for r in edges.collect()}
    assert got == {("u", "py", "INFERRED", 1, 1), ("v", "js", "AMBIGUOUS", 2, 1), ("v", "ts", "AMBIGUOUS", 2, 1), ("w", "s1", "INFERRED", 1, 1), ("w2", "s1", "AMBIGUOUS", 2, 1), ("w2", "s2", "AMBIGUOUS", 2, 1), ("w3", "h", "INFERRED", 1, 1), ("n", "py", "AMBIGUOUS", 3, 1), ("n", "js", "AMBIGUOUS", 3, 1), ("n", "ts", "AMBIGUOUS", 3, 1)}
    assert {r["fate"]: r["n"] for r in counts.collect()} == {"resolved": 5, "ambiguous": 3, "dropped": 1}
    assert graph.resolve_references(refs, defs, "calls", ["function"], per_site=True)[0].where("src = 'u'").count() == 2


def test_methods_find_their_class(spark):
    classes = frame(spark, [("c1", "Box", "NS.Box"), ("c2", "Box", "Other.Box"), ("c3", "Lid", "NS.Lid")], "node_id string, name string, chain string")
    pending = frame(spark, [("m1", "NS.Box"), ("m2", "Box"), ("m3", "Lid"), ("m4", "S.Lid"), ("m5", "None")], "node_id string, qualifier string")
    assert {tuple(r) for r in graph.resolve_methods(pending, classes).collect()} == {("m1", "c1"), ("m3", "c3")}


# ---- extraction

PY = '''
import os
from a.b import c

LIMIT = 3


class Widget(Base, mixins.Loud):
    def draw(self):
        def inner():
            return helper(LIMIT)
        return self.paint()


async def top():
    os.walk(".")


if __name__ == "__main__":
    top()
'''


def test_python_definitions_and_references():
    defs, refs = extract.parse("w.py", "python", PY)
    assert {(d["kind"], d["qualified_name"]) for d in defs} == {("global_variable", "LIMIT"), ("class", "Widget"), ("method", "Widget.draw"), ("function", "Widget.draw.inner"), ("function", "top"), ("entry_point", "__main__")}
    assert {(r["stream"], r["src"], r["name"]) for r in refs} == {("imports", "", "os"), ("imports", "", "a.b"), ("inherits", "Widget", "Base"), ("inherits", "Widget", "Loud"), ("calls", "Widget.draw.inner", "helper"), ("uses", "Widget.draw.inner", "LIMIT"), ("calls", "Widget.draw", "paint"), ("calls", "top", "walk"), ("calls", "", "top")}
    assert extract.parse("x.py", "python", "def (") == ([], []) and extract.parse("x.py", "python", "x\x00") == ([], [])


def test_braced_definitions():
    source = 'namespace NS {\nclass Box : public Base {\n public:\n  int put(int x) { return helper(x); }\n};\n}\nint NS::Box::get() { // call(1)\n  return "no(1)"[0] + put(2);\n}\nint main() { if (x) { go(); } }\n'
    defs, refs = extract.parse("b.cpp", "cpp", source)
    assert {(d["kind"], d["qualified_name"], d["qualifier"]) for d in defs} == {("namespace", "NS", ""), ("class", "NS.Box", ""), ("method", "NS.Box.put", ""), ("function", "NS.Box.get", "NS.Box"), ("entry_point", "main", "")}
    assert {(r["stream"], r["src"], r["name"]) for r in refs} == {("inherits", "NS.Box", "Base"), ("calls", "NS.Box.put", "helper"), ("calls", "NS.Box.get", "put"), ("calls", "main", "go")}


def test_sql_constraints_and_statements():
    defs, refs = extract.parse("a.sql", "sql", "create table a (x int);\ncreate table b (y int);\nalter table b add constraint fk foreign key (y) references a(x);\nupdate a set x = 1; select * from b join a on 1 = 1;")
    assert {d["name"] for d in defs} == {"a", "b"}
    assert {(r["stream"], r["name"]) for r in refs} == {("references", "a"), ("writes", "a"), ("reads", "b"), ("reads", "a")}
    assert extract.embedded_sql("it comes from the shelf and goes into the box") == []
    assert {(r["stream"], r["name"]) for r in extract.embedded_sql('q("DELETE FROM logs WHERE x"); q("INSERT INTO t SELECT a FROM s")')} == {("writes", "logs"), ("writes", "t"), ("reads", "s")}


def test_hcl_xml_xsd_xsl_adr_styles():
    defs, refs = extract.parse_hcl('variable "env" {}\nlocals {\n  a = var.env\n}\nmodule "m" {\n  source = "./x"\n  v = data.aws_ami.img.id # var.none\n}\n')
    assert {d["name"] for d in defs} == {"var.env", "local.a", "module.m"} and {(r["src"], r["name"]) for r in refs} == {("local.a", "var.env"), ("module.m", "data.aws_ami.img")}
    keys = extract.parse_xml('<c>\n<add key="Timeout" value="5"/>\n<add key="ApiKey" value="x1"/><add name="db" connectionString="Server=x"/></c>')
    assert [(k["name"], k["value"], k["line"]) for k in keys] == [("Timeout", "5", 2), ("ApiKey", None, 3), ("db", None, 3)]
    defs, refs = extract.parse_xsd('<xs:schema><xs:complexType name="T"><xs:element name="in" type="U"/></xs:complexType><xs:simpleType name="U"><xs:restriction base="xs:string"/></xs:simpleType><xs:simpleType name="u"><xs:restriction base="V"/></xs:simpleType></xs:schema>')
    assert [d["name"] for d in defs] == ["T", "U"] and [(r["src"], r["name"]) for r in refs] == [("T", "U")]
    defs, refs = extract.parse_xsl('<xsl:template name="a"><xsl:call-template name="b"/></xsl:template><xsl:template match="x/y"/>')
    assert [d["name"] for d in defs] == ["a", "x/y"] and [(r["src"], r["name"]) for r in refs] == [("a", "b")]
    assert extract.parse_adr("docs/adr/001.md", "# 1. Use Spark\n\n## Status\n\nAccepted\n") == {"kind": "adr", "name": "Use Spark", "status": "accepted", "line": 1} and extract.parse_adr("a.md", "# x") is None
    assert extract.parse_styles("a.html", '<p class="x y"/>')[1][1]["name"] == "y" and [d["name"] for d in extract.parse_styles("a.css", ".x .y:hover, #z { }")[0]] == ["x", "y", "z"]
    assert extract.mask_embedded("a;\nEXEC SQL SELECT x INTO :y\nFROM t;\nb;").replace(" ", "") == "a;\n\n\nb;"


def test_flows():
    assert extract.http_flow('@app.get("/v1/users/{id}")\ndef x(): requests.post("https://Api.x.org/v2/orders/12?a=1")\n', "python") == [
        {"relation": "exposes", "endpoint": "/v1/users/{}", "method": "GET", "host": None, "line": 1}, {"relation": "calls_http", "endpoint": "/v2/orders/{}", "method": "POST", "host": "api.x.org", "line": 2}]
    assert extract.http_flow('client.get("/{}")\nclient.get("name")', "python") == []
    assert [(x["relation"], x["topic"]) for x in extract.event_flow('kafkaProducer.send("eu/Orders"); producer.send("test"); bus.publish("not-a-topic"); socket.send("nor-this"); c.subscribe("Orders")')] == [("publishes_event", "orders"), ("consumes_event", "orders")]
    state = 'class Order:\n  def pay(self):\n    if self.status == "open":\n      self.status = "paid"\n    if self.status == "paid":\n      pass\n    else:\n      self.status = "lost"\n'
    assert [(x["entity"], x["source"], x["target"], x["method"]) for x in extract.state_flow(state, "python")] == [("Order", "open", "paid", "pay")]
    assert extract.file_route("src/app/(shop)/items/[id]/page.tsx") == "/items/{}" and extract.file_route("pages/about.js") == "/about" and extract.file_route("app/x/util.ts") is None
    assert [x["route"] for x in extract.web_routes("a.jsx", '<Link to="/cart">x</Link> {path: "/u/:id"}', "javascript")] == ["/u/{}", "/cart"]


def test_index_repo(spark):
    tree = frame(spark, [("a.h", "cpp", "class Box {\n  int get();\n};\n"), ("a.cpp", "cpp", "int Box::get() { return helper(1); }\nstatic int helper(int x) { return x; }\n"), ("b.cpp", "cpp", "static int helper(int x) { return x; }\n"), ("bad.py", "python", "def (")], "file string, lang string, content string")
    nodes, edges, counts = extract.index_repo(tree, "r")
    names = {r["node_id"]: (r["kind"], r["name"], r["file"]) for r in nodes.collect()}
    got = {(r["relation"], names[r["src"]][1], names[r["dst"]][1], names[r["dst"]][2]) for r in edges.collect()}
    assert ("contains", "Box", "get", "a.cpp") in got and ("calls", "get", "helper", "a.cpp") in got and ("calls", "get", "helper", "b.cpp") not in got
    assert ("file", "bad.py", "bad.py") in names.values() and [tuple(r) for r in counts.where("stream = 'calls'").select("fate", "n").collect()] == [("resolved", 1)]


def test_index_repo_reads_a_tree_once(spark, tmp_path):
    seen = tmp_path / "seen"

    def told(batches):
        for pdf in batches:
            with open(seen, "a") as f:
                f.writelines(f"{x}\n" for x in pdf["file"])
            yield pdf

    rows = [(f"m{k}.py", "python", f"class C{k}(C{k - 1}):\n    def m{k}(self):\n        return h{k}()\n\n\ndef h{k}():\n    return 1\n") for k in range(4)]
    schema = "file string, lang string, content string"
    nodes, edges, counts = extract.index_repo(frame(spark, rows, schema).coalesce(1).mapInPandas(told, schema), "r")
    assert edges.groupBy("relation").count().orderBy("relation").collect() == [("calls", 4), ("contains", 12), ("inherits", 3)] and nodes.count() == 16
    assert {(r["stream"], r["n"]) for r in counts.collect()} == {("calls", 4), ("inherits", 3)}
    assert len(seen.read_text().split()) <= 2 * len(rows)  # the files are counted, then parsed
    assert [x.count() for x in extract.index_repo(frame(spark, [("a.txt", "text", "x")], schema), "r")] == [1, 0, 0]


# ---- sources and sinks


def test_pages_and_services():
    assert web.html_to_text("<svg><title>icon</title></svg><title>T</title><p>x<b>y</b></p>") == ("T", "x\ny")
    deep: dict = {"pageInfo": {"hasNextPage": True}}
    for _ in range(5000):
        deep = {"x": deep}
    assert web.has_next_page(deep) and not web.has_next_page({"hasNextPage": True})
    with pytest.raises(ValueError):
        list(web.page_infos([[] for _ in range(20)], most=10))
    linked = {"a": ("1", '<b>; rel="next"'), "b": ("2", '<a>; rel="next"')}
    assert list(web.pages_of(linked.__getitem__, "a")) == ["1", "2"]
    marks = {"s": '{"n": {"c": "x y"}}', "s?cursor=x%20y": '{"n": {"c": null}}'}
    assert len(list(web.pages_of(lambda u: (marks[u], None), "s", cursor="n.c"))) == 2
    assert len(list(web.pages_of(lambda u: (f'{{"c": "{u}"}}', None), "s", cursor="c", most=4))) == 4


def test_manifests(spark):
    pom = "<project><parent><groupId>g</groupId></parent><artifactId>app</artifactId><dependencies><dependency><groupId>o</groupId><artifactId>lib</artifactId><version>1</version></dependency><dependency><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>"
    assert files.parse_manifest("pom.xml", pom) == [{"package": "o:lib", "constraint": "1", "group": "runtime"}, {"package": "t", "constraint": None, "group": "dev"}] and files.published("pom.xml", pom) == "g:app"
    proj = '<Project><PackageId>P</PackageId><PackageReference Include="A" Version="2"/><PackageReference Include="B"><Version>3</Version><PrivateAssets>all</PrivateAssets></PackageReference></Project>'
    assert files.parse_manifest("x.csproj", proj) == [{"package": "A", "constraint": "2", "group": "runtime"}, {"package": "B", "constraint": "3", "group": "dev"}] and files.published("x.csproj", proj) == "P"
    rows = frame(spark, [("a/pom.xml", pom), ("b.txt", "x"), ("c/package.json", "{")], "file string, content string")
    assert {(r["relation"], r["package"]) for r in files.manifest_edges(rows).collect()} == {("publishes", "g:app"), ("depends_on", "o:lib"), ("depends_on", "t")}


def test_generated_and_dispatch(spark):
    rows = frame(spark, [("a/x.MIN.js", ""), ("AssemblyInfo.cs", ""), ("a.go", "// Code generated by x"), ("b.py", "auto generated"), ("p/package.json", "{}"), ("docs/adr/1.md", "# x"), ("r.md", ""), ("x.bin", "")], "file string, content string")
    got = [tuple(r) for r in rows.select(files.is_generated(F.col("file"), F.col("content")), files.dispatch(F.col("file"))).collect()]
    assert got == [(True, "code"), (True, "code"), (True, "code"), (False, "code"), (False, "manifest"), (False, "adr"), (False, "document"), (False, "other")]


def test_document_source(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# Title\ntext")
    (tmp_path / "b.html").write_text("<title>B</title><p>body</p>")
    (tmp_path / "c.md").write_text("  ")
    (tmp_path / "d.py").write_text("x = 1")
    assert sorted((r["title"], r["text"]) for r in files.read_documents(spark, str(tmp_path)).collect()) == [("B", "body"), ("Title", "intro\n# Title\ntext")]


def test_sinks_and_sources(spark, tmp_path):
    rows = frame(spark, [("r", ["a", "b"], 1)], "repo string, files array<string>, n int")
    sinks.write_audit(rows, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit/json")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "audit/csv")).first()["files"] == '["a","b"]'
    m = frame(spark, [("up time", {"repo": 'a"b'}, 1.0, "h")], "name string, labels map<string,string>, value double, help string")
    sinks.write_textfile(m, str(tmp_path / "m.prom"))
    assert (tmp_path / "m.prom").read_text() == '# HELP up_time h\n# TYPE up_time gauge\nup_time{repo="a\\"b"} 1.0\n' and not os.path.exists(tmp_path / "m.prom.part")
    (tmp_path / "x.json").write_text(json.dumps({"d": {"items": [{"id": 1, "a": {"b": "x"}}, {"id": 2}]}}))
    assert "weft_records" in sinks.register_sources(spark)
    got = spark.read.format("weft_records").option("paths", str(tmp_path / "x.json")).option("records", "d.items").option("fields", "id=id;b=a.b").load().collect()
    assert [tuple(r) for r in got] == [("1", "x"), ("2", None)]


def test_shards_lazily_and_as_of(spark, tmp_path):
    p, h, t = (str(tmp_path / x) for x in ("nodes", "history", "target"))
    a = frame(spark, [("n1", "007", "10"), ("n2", "r2", "11"), ("n3", "@enrich:r2", "11")], "node_id string, repo_id string, parser string")
    shards.write_shard(a, p)
    lazy = shards.LazyShard(spark, p, "007")
    assert lazy.exists() and not lazy.changed() and lazy.rows().first()["repo_id"] == "007" and not shards.LazyShard(spark, p, "none").exists()
    assert {tuple(r) for r in shards.parser_versions(spark, p).collect()} == {("007", "10"), ("r2", "11"), ("@enrich:r2", "11")}
    shards.write_shard(a.where("repo_id = '007'"), p)
    assert lazy.changed() and shards.rebuild(spark, p, t, "007") == 1
    with pytest.raises(LookupError):
        shards.rebuild(spark, p, t, "none")
    shards.archive(a, h, "c1")
    history = frame(spark, [("007", "c1", "2024-01-01 00:00:00")], "repo_id string, commit string, at string").withColumn("indexed_at", F.to_timestamp("at"))
    assert shards.read_as_of(spark, h, history, "007", "2024-05-01").count() == 1
    with pytest.raises(LookupError):
        shards.read_as_of(spark, h, history, "007", "2023-05-01")
    later = frame(spark, [("r2", "c1", "2024-01-02 00:00:00"), ("r2", "c2", "2024-01-03 00:00:00"), ("007", "c2", "2024-06-01 00:00:00")], "repo_id string, commit string, at string").withColumn("indexed_at", F.to_timestamp("at"))
    shards.archive(a.where("repo_id in ('007', 'r2')"), h, "c2")
    fleet_then = lambda at: {(r["repo_id"], r["commit"]) for r in shards.snapshots_at(spark, h, history.unionByName(later), at).collect()}
    assert fleet_then("2024-03-01") == {("007", "c1"), ("r2", "c2")} and fleet_then("2024-07-01") == {("007", "c2"), ("r2", "c2")} and fleet_then("2023-01-01") == set()
    shards.forget(spark, [p], "r2")
    assert {r["repo_id"] for r in shards.read_shard(spark, p).collect()} == {"007"}
    assert shards.migrate(spark, p, "007", "new") == 1 and shards.migrate(spark, p, "007", "new") == 0 and shards.large_shards(a, 0).count() == 3


def test_stream_takes_a_shard_in_two_batches(spark, tmp_path):
    schema = "repo_id string, head string, parser string, seq long, node_id string"
    put = lambda rows: frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: incremental.index_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    for rows in ([("r1", "h1", "10", 1, "one")], [("r1", "h1", "10", 1, "two"), ("r1", "h1", "10", 1, "one")], [("r1", "h0", "10", 0, "late")]):
        put(rows)
        run()
    assert sorted(r["node_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_stream_of_many_repositories_has_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKETS", 8)
    schema = "repo_id string, head string, parser string, seq long, node_id string"
    at = {k: str(tmp_path / k) for k in ("in", "out", "state", "cp")}
    for head, most in (("h1", 60), ("h2", 20)):
        rows = [(str(i), head, "10", int(head[1]), f"{head}-{j}") for i in range(most) for j in range(2)]
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(at["in"])
        incremental.index_stream(spark, at["in"], schema, at["out"], at["state"], at["cp"]).awaitTermination()
    want = sorted((str(i), f"{'h2' if i < 20 else 'h1'}-{j}") for i in range(60) for j in range(2))
    assert sorted((r["repo_id"], r["node_id"]) for r in shards.read_table(spark, at["out"]).collect()) == want
    assert all(len(list((tmp_path / k).glob("*=*"))) <= shards.BUCKETS for k in ("out", "state"))
    shards.forget(spark, [at["out"]], "7")
    assert shards.migrate(spark, at["out"], "8", "eight") == 2
    kept = [((r, n) if r != "8" else ("eight", n)) for r, n in want if r != "7"]
    assert sorted((r["repo_id"], r["node_id"]) for r in shards.read_table(spark, at["out"]).collect()) == sorted(kept)


# ---- text, traversal, retrieval


def test_leaks_in_a_long_text_take_linear_time(spark):
    words = [f"w{i}" for i in range(20_000)]
    docs = frame(spark, [(1, " ".join(words)), (2, None), (3, "short")], "doc_id long, text string")
    item = frame(spark, [(7, " ".join(words[19_000:19_014]))], "item_id long, text string")
    t = time.time()
    assert [tuple(r) for r in text.leaked_spans(docs, item).collect()] == [(1, 7, 3)]
    assert time.time() - t < 30


def test_blast_radius_defaults(spark):
    e = frame(spark, [("A", "S", "calls", "INFERRED", 4), ("A", "S", "reads", "EXTRACTED", 9), ("B", "A", "writes", "EXTRACTED", 1), ("I", "S", "imports", "EXTRACTED", 1), ("C", "S", "contains", "EXTRACTED", 1), ("X", "S", "uses", "EXTRACTED", 2), ("Y", "X", "calls", "EXTRACTED", 3)], "src string, dst string, relation string, confidence string, source_line int")
    nodes = frame(spark, [(x,) for x in "SABICY"], "node_id string")
    got = {(r["node_id"], r["hop"], r["relation"], r["line"], r["truncated"]) for r in traverse.blast_radius(e, frame(spark, [("S",)], "node_id string"), nodes=nodes).collect()}
    assert got == {("A", 1, "reads", 9, False), ("B", 2, "writes", 1, False)}
    cut = traverse.blast_radius(e, frame(spark, [("S",)], "node_id string"), limit=1).collect()
    assert [(r["node_id"], r["truncated"]) for r in cut] == [("A", True)]


def test_paths_and_sequences(spark):
    e = frame(spark, [("A", "B", "calls", "INFERRED", 4), ("C", "B", "uses", "EXTRACTED", 7)], "src string, dst string, relation string, confidence string, source_line int")
    path = traverse.shortest_path(e, "A", "C")
    assert [tuple(r) for r in traverse.path_citations(e, path).orderBy("step").collect()] == [(0, "A", "B", "calls", "INFERRED", 4, True), (1, "B", "C", "uses", "EXTRACTED", 7, False)]
    assert traverse.path_gap(path, "A", "C") is None and "no path" in traverse.path_gap(traverse.shortest_path(e, "A", "Z"), "A", "Z")
    calls = [("a", "b", 2), ("a", "c", 1), ("b", "a", 5), ("c", "b", 9)]
    assert traverse.call_sequence(calls, "a") == [("a", "c", 1), ("c", "b", 9), ("b", "a", 5), ("a", "b", 2), ("b", "a", 5)] and len(traverse.call_sequence(calls, "a", 2)) == 2


def test_a_round_of_sequences_holds_only_what_it_reaches(spark, monkeypatch):
    """A chain of six, each with five calls that lead nowhere: every caller is written once, calls and earlier rounds are not written again."""
    made, plain = [], traverse.work_table
    monkeypatch.setattr(traverse, "work_table", lambda df, name, *a: made.append(plain(df, name, *a)) or made[-1])
    calls = [(f"n{i}", f"leaf{i}{k}", k) for i in range(6) for k in range(5)] + [(f"n{i}", f"n{i + 1}", 2) for i in range(5)] + [("n5", "n0", None)]
    rows = traverse.call_sequences(frame(spark, calls, "src string, dst string, line int"), frame(spark, [("n0",)], "node_id string")).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["line"]) for r in rows] == traverse.call_sequence(calls, "n0")
    assert sum(x.count() for x in made) == 6


def test_sequences_of_many_starts_equal_those_of_one(spark):
    schema = "src string, dst string, line int"
    calls = [("a", "b", 2), ("a", "c", 1), ("b", "a", 5), ("c", "b", 9), ("c", "b", 9), ("c", "d", None), ("d", "d", 3), ("e", "a", 1), ("e", "f", 1), ("e", "c", None)]
    rows = frame(spark, [*calls, (None, "a", 1), ("a", None, 1)], schema)
    for most in (4, 200):
        starts = frame(spark, [("a",), ("c",), ("e",), ("f",), ("a",), (None,)], "node_id string")
        got = traverse.call_sequences(rows, starts, most).orderBy("start", "step").collect()
        for start in "acef":
            own = [r for r in got if r["start"] == start]
            assert [(r["src"], r["dst"], r["line"]) for r in own] == traverse.call_sequence(calls, start, most)
            assert [r["step"] for r in own] == list(range(len(own)))
    assert {(r["src"], r["dst"], r["depth"]) for r in got if r["start"] == "c" and r["back"]} == {("d", "d", 2), ("a", "c", 3), ("a", "b", 3)}
    assert traverse.call_sequences(rows, starts.limit(0)).count() == 0 and traverse.call_sequences(rows.limit(0), starts).count() == 0
    wide = frame(spark, [("h", f"x{i:04}", i % 7) for i in range(3000)], schema)
    got = traverse.call_sequences(wide, frame(spark, [("h",)], "node_id string"), 50).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["line"]) for r in got] == traverse.call_sequence([tuple(r) for r in wide.collect()], "h", 50)


def test_ann_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0")
    exact = search.knn_edges(v, 10).withColumnRenamed("src", "query_id").withColumnRenamed("dst", "vec_id").where("query_id % 50 = 0")
    assert embed.recall(embed.ann_topk(v, q, 10, 0.85, 20), exact) >= 0.9


def test_embedding_store(spark, tmp_path):
    p = str(tmp_path / "v")
    nodes = frame(spark, [("a", "r1", "class", "A", "a.py"), ("b", "r2", "package", "B", None)], "node_id string, repo_id string, kind string, name string, file string")
    assert embed.embed_repo(nodes.where("repo_id = 'r1'"), p) and not embed.embed_repo(nodes.where("repo_id = 'r2'"), p)
    stored = shards.read_table(spark, p)
    embed.guard_identity(spark, p, 64, "hashed-words")
    with pytest.raises(ValueError):
        embed.guard_identity(spark, p, 128, "hashed-words")
    assert embed.unpopulated_reason(stored, nodes, "r1") is None and "no node" in embed.unpopulated_reason(stored, nodes, "r2") and "no vectors" in embed.unpopulated_reason(stored.limit(0), nodes)


def test_ingest_replaces_its_partition(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("n", "v", "e")]
    docs = frame(spark, [(1, "r", "t", "about parse_source\n\n" + "x " * 900), (2, "r", None, None)], "doc_id long, repo_id string, title string, text string")
    symbols = frame(spark, [("s", "parse_source"), ("u", "unknown")], "node_id string, name string")
    first = embed.ingest(docs, symbols, *paths)
    assert first == embed.ingest(docs, symbols, *paths) and first["nodes"] == 2 and first["edges"] == 3 and first["chunks"] >= 2


def graph_of(spark):
    n = frame(spark, [("s", "g/api", "class", "Store", "src/store.py", 1), ("m", "g/api", "class", "MemStore", "src/mem.py", 1), ("f", "g/api", "function", "load", "src/l.py", 4)], "node_id string, repo_id string, kind string, name string, file string, line_start int")
    e = frame(spark, [("m", "s", "inherits", "EXTRACTED", 1, "g/api"), ("f", "s", "calls", "EXTRACTED", 5, "g/api")], "src string, dst string, relation string, confidence string, source_line int, repo_id string")
    return n, e


def test_ask(spark):
    n, e = graph_of(spark)
    on = lambda q, **k: ask.ask(n, e, q, **k)
    assert [r["name"] for r in on("where is Store defined").rows.collect()] == ["Store"]
    assert [r["node_id"] for r in on("who implements Store").rows.collect()] == ["m"] and [r["node_id"] for r in on("who calls Store").rows.collect()] == ["f"]
    assert {r["node_id"] for r in on("what breaks if I change Store").rows.collect()} == {"m", "f"}
    missed = on("where is load_missing defined")
    assert missed.route == "definition" and "not in the graph" in missed.established and missed.rows.count() == 0
    filtered = on("where is Store defined", repo="g/other")
    assert "filters" in filtered.established
    commits = frame(spark, [("g/api", "ann", "2024-01-01 00:00:00", 3)], "repo_id string, author string, ts string, lines int").withColumn("ts", F.to_timestamp("ts"))
    assert on("who owns the api", commits=commits).rows.first()["author"] == "ann"
    pages = frame(spark, [("g/api", "prose")], "repo_id string, page string")
    told = on("explain the api", pages=pages)
    assert told.rows.first()["page"] == "prose" and "advisory" in told.note
    assert "nothing in the graph" in on("logic for xylophones").note


def test_vector_tool_and_golden(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    n = frame(spark, [(1, "r", "class", "A", "f", 1)], "node_id long, repo_id string, kind string, name string, file string, line_start int")
    rows, note = ask.vector_tool(v, n, [1.0, 0.0])
    assert [r["name"] for r in rows.collect()] == ["A"] and note == "1 stale hits were dropped"
    assert ask.vector_tool(v, n, [])[1] == "empty query" and "embed" in ask.vector_tool(v.limit(0), n, [1.0])[1]
    assert ask.load_golden([{"query": "q", "expected": ["A"]}])[0]["match"] == "name"
    for bad in ({"query": " ", "expected": ["A"]}, {"query": "q", "expected": []}, {"query": "q", "expected": ["A"], "match": "x"}):
        with pytest.raises(ValueError):
            ask.load_golden([bad])
    g, e = graph_of(spark)
    assert ask.fts_retriever(g)("Store").first()["node_id"] == "s"
    assert ask.semantic_retriever(v, lambda q: [0.0, 1.0])("x").first()["node_id"] == 2
    assert ask.hybrid_retriever(v, frame(spark, [(1, 2)], "src long, dst long"), lambda q: [1.0, 0.0])("x").first()["node_id"] == 1


# ---- gates, views, scalars


def test_replacement_gate_edges(spark):
    page = "# P\n\n## Hubs\n- `a`\n\n## Size\nno names\n"
    rows = frame(spark, [(1, "says `a`", page), (2, "says a", page), (3, "`z`", page), (4, "nothing", page), (5, "", "")], "page_id int, draft string, page string")
    assert [(r["page_id"], r["accepted"]) for r in health.replacement_gate(rows, ["Hubs", "Size", "Absent"]).orderBy("page_id").collect()] == [(1, True), (2, True), (3, False), (4, False), (5, True)]


def test_views_refuse_what_cannot_be_drawn(spark, monkeypatch):
    monkeypatch.setattr(views, "MOST_LINES", 3)
    with pytest.raises(ValueError):
        views.checked(spark.range(5), 3)
    n = frame(spark, [("a", "A", "function")], "node_id string, name string, kind string")
    e = frame(spark, [], "src string, dst string, relation string")
    assert "no classes" in views.class_diagram(n, e).first()[0] and "no tables" in views.er_diagram(n, e).first()[0]


def test_subgraph_keeps_its_caps(spark):
    n = frame(spark, [(f"f{i}", "r", "function", None) for i in range(30)] + [("t", "r", "table", None)] + [(f"x{i}", "o", "package", None) for i in range(20)], "node_id string, repo_id string, kind string, file string")
    e = frame(spark, [(f"f{i}", f"f{(i + 1) % 30}", "contains") for i in range(30)] + [(f"f{i}", f"x{i}", "depends_on") for i in range(20)], "src string, dst string, relation string")
    kept, ends = views.repo_subgraph(n, e, "r", most=10, most_edges=5)
    ids = {r["node_id"] for r in kept.collect()}
    assert len(ids) == 10 and "t" in ids and sum(x.startswith("x") for x in ids) == 2
    got = ends.collect()
    assert len(got) <= 5 and all(r["src"] in ids and r["dst"] in ids for r in got)


def test_scalars(spark):
    r = frame(spark, [("1700000000", "1700000000000", "2024-01-02T03:04:05Z", "never")], "a string, b string, c string, d string").select(*[F.unix_timestamp(scalars.iso_instant(F.col(c))).alias(c) for c in "abcd"]).first()
    assert r["a"] == r["b"] == 1_700_000_000 and r["c"] == 1704164645 and r["d"] is None
    scalars.register(spark)
    assert spark.sql("SELECT weft_path('https://x.org/users/12?q=1'), weft_topic('arn:x:Orders'), weft_id('A b--C')").first()[:] == ("/users/{}", "orders", "a_b_c")
    assert spark.sql("SELECT chunk FROM weft_chunks('a b', 10, 2)").first()[0] == "a b"


def test_link_edges(spark):
    docs = frame(spark, [(1, "r"), (2, "r")], "doc_id long, repo_id string")
    found = frame(spark, [(1, "s", "AMBIGUOUS")], "doc_id long, node_id string, confidence string")
    assert links.link_documents(found, docs, "tracked_by").count() == 3 and links.link_documents(found, docs, "tracked_by", repo_edge=False).count() == 1


def test_serving_surface(spark):
    from weftgraph.serving import NAMES, Tools

    assert len(set(NAMES)) == 25 and {"graph_stats", "who_knows", "search_code", "get_fleet_doc", "ask"} <= set(NAMES)
    n, e = graph_of(spark)
    docs = frame(spark, [("wiki", "g/api", "prose"), ("readme", "g/api", "read")], "kind string, key string, text string")
    commits = frame(spark, [("g/api", "a@x", "Ann", "2024-01-01 00:00:00", 3)], "repo_id string, email string, name string, ts string, lines int").withColumn("ts", F.to_timestamp("ts"))
    repos = frame(spark, [("g/api", "h2", "h1", "1", None)], "repo_id string, head string, indexed_head string, indexed_parser string, state string")
    t = Tools(n, e, repos=repos, commits=commits, documents=docs)
    assert t.find_definition("Store").rows.first()["cite"] == "src/store.py:1" and "not in the graph" in t.find_definition("Nope").note
    assert t.find_callers("Store").rows.first()["node_id"] == "f" and t.find_callees("load").rows.first()["node_id"] == "s" and t.find_callers("Nope").rows.count() == 0
    assert {r["node_id"] for r in t.blast_radius("Store").rows.collect()} == {"m", "f"} and t.shortest_path("MemStore", "load").rows.count() == 2
    assert t.get_neighbors("s", limit=1).note and t.get_neighbors("s").rows.count() == 2 and t.search_code("store").rows.count() == 1
    assert t.who_knows("api").rows.first()["name"] == "Ann" and t.get_repo_brief("api").rows.first()["n_nodes"] == 3 and t.graph_health().rows.first()["stale"] == 1
    assert t.get_readme("g/api").rows.first()["text"] == "read" and "advisory" in t.get_wiki("g/api").note and "no fleet" in t.get_fleet_doc().note
    assert t.repo_flow().note and t.semantic_search("x").note and t.ask("who calls Store").rows.first()["node_id"] == "f"


def test_small_operators(spark):
    rows = frame(spark, [("r", "a", 5.0, 1.0), ("r", "b", 1.0, 9.0)], "repo string, branch string, commits double, ts double")
    assert [fleet.active_branch(rows, s).first()["branch"] for s in ("commits", "recency", "hybrid")] == ["a", "b", "a"]
    with pytest.raises(ValueError):
        fleet.active_branch(rows, "none")
    n, e = graph_of(spark)
    assert graph.clamped(0) == 1 and graph.clamped(10**6) == 500 and graph.listing(n, 0, "node_id").first()["truncated"]
    assert [r[0] for r in graph.seed_ids(n, names=["Store"]).collect()] == ["s"] and graph.seed_ids(n).count() == 0 and graph.seed_ids(n, query="store").first()[0] == "s"
    hits, others = ask.impact_with_candidates(n.unionByName(n.where("node_id = 's'").withColumn("node_id", F.lit("s2"))), e, "Store")
    assert {r["node_id"] for r in hits.collect()} == {"m", "f"} and [r["node_id"] for r in others.collect()] == ["s2"]
    assert "no indexed symbol" in ask.path_with_candidates(n, e, "Nope", "Store")[1]
    symbols = frame(spark, [("x", "auth-service"), ("y", "a.b"), ("z", "run"), ("w", "run"), ("v", "go")], "node_id string, name string")
    got = {tuple(r)[1:] for r in text.mentions(frame(spark, [(1, "see the auth-service, x.a.b.c and run."), (2, None), (3, "auth service go")], "doc_id long, text string"), symbols).collect()}
    assert got == {("x", "INFERRED"), ("y", "INFERRED"), ("z", "AMBIGUOUS"), ("w", "AMBIGUOUS")}
