"""Extractors on long, deep and hostile texts, and the languages and manifests that came later."""

import random
import time

import pytest

from weftgraph.sources import blocks, extract, shards, xmlread


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


HOSTILE = {
    "embedded": lambda n: extract.embedded_sql("select a " * (n // 9)),
    "alter": lambda n: extract.parse_sql("alter table t add " * (n // 18)),
    "braced": lambda n: extract.parse_braced("int f%d(int a) {\n  g(a);\n}\n" * (n // 30), "c"),
    "python": lambda n: extract.parse_python("def f(a):\n    return g(a)\n\n" * (n // 30)),
    "styles": lambda n: extract.parse_styles("a.css", ".a%d { x: y }\n" * (n // 16)),
    "http": lambda n: extract.http_flow("app.get('/v1/things', f)\n" * (n // 26), "javascript"),
    "state": lambda n: extract.state_flow("class A:\n def m(self):\n  if o.status == 'a':\n   o.status = 'b'\n" * (n // 70), "python"),
    "events": lambda n: extract.event_flow("kafka.send('a" * (n // 13)),
    "hcl": lambda n: extract.parse_hcl('resource "a" "b" {\n  x = var.y\n}\n' * (n // 36)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_two_megabytes_take_seconds(name):
    began = time.time()
    HOSTILE[name](2_000_000)
    assert time.time() - began < 12


def test_deep_trees_do_not_fail(spark):
    files = frame(spark, [("deep.py", "python", "def f():\n    return " + " + ".join(["g(x)"] * 3000) + "\n"), ("good.py", "python", "class A:\n    def m(self):\n        return B\n")], "file string, lang string, content string")
    assert {(r["file"], r["name"]) for r in extract.definitions(files).collect()} == {("deep.py", "deep.py"), ("deep.py", "f"), ("good.py", "good.py"), ("good.py", "A"), ("good.py", "m")}
    assert extract.references(files).where("stream = 'calls' and src = 'f'").count() == 3000


def test_lines_are_counted_from_one():
    r = random.Random(1)
    text = "".join(r.choice("ab\n") for _ in range(500))
    assert all(extract.line_of(text, i) == text.count("\n", 0, i) + 1 for i in range(501))


def test_frameworks():
    said = lambda lang, code: [(x["relation"], x["method"], x["endpoint"]) for x in extract.http_flow(code, lang)]
    assert said("python", "@api.route('/items/<int:i>')\n@app.get(\"/things\")\nurlpatterns = [path('shop/list', v)]\nrequests.post(f'https://h/v1/orders')") == [("exposes", "ROUTE", "/items/{}"), ("exposes", "GET", "/things"), ("exposes", "*", "/shop/list"), ("calls_http", "POST", "/v1/orders")]
    assert said("java", '@GetMapping(value = "/a/{id}/bb")\nrest.exchange("http://x/cc/1", y)') == [("exposes", "GET", "/a/{}/bb"), ("calls_http", "EXCHANGE", "/cc/{}")]
    assert said("csharp", '[HttpPost("orders")]\napp.MapGet("/list", f);\nclient.GetAsync<List>($"api/list");') == [("exposes", "POST", "/orders"), ("exposes", "GET", "/list"), ("calls_http", "GET", "/api/list")]
    assert said("javascript", "fetch(`/v1/users`); router.use('/admin', r)") == [("exposes", "USE", "/admin"), ("calls_http", "*", "/v1/users")]
    assert said("go", 'r.GET("/pets", h)\nhttp.Get("http://s/cats")') == [("exposes", "GET", "/pets"), ("calls_http", "GET", "/cats")]


def test_lazy_shards_of_any_id(spark, tmp_path):
    p = str(tmp_path / "s")
    shards.write_shard(frame(spark, [("AFRICA/NATION_0", 1), ("@connect:x", 2), ("plain", 3)], "repo_id string, v int"), p)
    assert [shards.LazyShard(spark, p, x).exists() for x in ("AFRICA/NATION_0", "@connect:x", "plain", "none")] == [True, True, True, False]


# ---- languages with scopes by keyword

CODE = {
    "ruby": (
        "module Acme\n class Animal\n  def speak; end\n end\n class Dog < Base::Animal\n  def bark\n   return 1 if loud?(x)\n   while go do\n    run(1)\n   end\n   [1].each do |x| puts x end\n   y = if a then b else c end\n  end\n  def self.make(a) = new(a)\n end\nend\n# class No; end\n",
        {("class", "Acme"), ("class", "Acme.Animal"), ("method", "Acme.Animal.speak"), ("class", "Acme.Dog"), ("method", "Acme.Dog.bark"), ("method", "Acme.Dog.make")},
        {("inherits", "Acme.Dog", "Animal"), ("calls", "Acme.Dog.bark", "loud?"), ("calls", "Acme.Dog.bark", "run")},
    ),
    "lua": (
        "local function helper(a)\n  if a then return go(a) end\n  for i = 1, 3 do step(i) end\n  repeat tick() until done\nend\nfunction M.open(x) return helper(x) end\n-- function no() end\n--[[ function no2() end ]]\n",
        {("function", "helper"), ("function", "M.open")},
        {("calls", "helper", "go"), ("calls", "helper", "step"), ("calls", "helper", "tick"), ("calls", "M.open", "helper")},
    ),
    "shell": ("#!/bin/sh\nbuild() {\n  compile x\n  if true; then pack y; fi\n}\nfunction main {\n  A=1\n  build\n}\n# no() {\nmain\n", {("function", "build"), ("function", "main")}, {("calls", "build", "compile"), ("calls", "build", "pack"), ("calls", "main", "build"), ("calls", "", "main")}),
    "scala": (
        'trait Handler { def serve(): Unit }\nclass Server(a: String) extends lib.Handler with Log { def serve(): Unit = { help("} class No") } }\nobject App { def main(): Unit = () }\n',
        {("interface", "Handler"), ("method", "Handler.serve"), ("class", "Server"), ("method", "Server.serve"), ("class", "App"), ("method", "App.main")},
        {("inherits", "Server", "Handler"), ("inherits", "Server", "Log"), ("calls", "Server.serve", "help")},
    ),
    "php": (
        "<?php\nnamespace App;\nuse App\\Base;\ninterface Auditable { public function audit(); }\nclass CatalogService extends Base implements Auditable, \\Lib\\Other {\n  public function get($id) { return $this->repo->find($id); }\n}\n",
        {("interface", "Auditable"), ("method", "Auditable.audit"), ("class", "CatalogService"), ("method", "CatalogService.get")},
        {("inherits", "CatalogService", "Base"), ("inherits", "CatalogService", "Auditable"), ("inherits", "CatalogService", "Other"), ("calls", "CatalogService.get", "find")},
    ),
    "swift": ("protocol Shape { func area() -> Double }\nclass Box: Base, Shape {\n  func area() -> Double { return side(2) }\n}\nfunc free() { area() }\n", {("interface", "Shape"), ("method", "Shape.area"), ("class", "Box"), ("method", "Box.area"), ("function", "free")}, {("inherits", "Box", "Base"), ("inherits", "Box", "Shape"), ("calls", "Box.area", "side"), ("calls", "free", "area")}),
    "plsql": (
        "CREATE OR REPLACE PACKAGE BODY shop IS\n  g NUMBER := 1;\n  PROCEDURE put(a IN NUMBER) IS\n    x NUMBER;\n  BEGIN\n    IF a > 1 THEN log_it(a); END IF;\n    FOR i IN 1..3 LOOP step(i); END LOOP;\n    BEGIN inner_call(1); END;\n    x := CASE WHEN a = 1 THEN 2 ELSE 3 END;\n  END put;\n  FUNCTION total(b NUMBER) RETURN NUMBER AS BEGIN RETURN calc(b); END;\n  PROCEDURE later(c NUMBER);\nBEGIN\n  setup(1);\nEND shop;\n-- PROCEDURE no IS\n",
        {("namespace", "shop"), ("function", "shop.put"), ("function", "shop.total"), ("function", "shop.later")},
        {("calls", "shop.put", "log_it"), ("calls", "shop.put", "step"), ("calls", "shop.put", "inner_call"), ("calls", "shop.total", "calc"), ("calls", "shop", "setup")},
    ),
}


@pytest.mark.parametrize("lang", CODE)
def test_scopes_by_keyword(lang):
    source, defs, refs = CODE[lang]
    got = blocks.parse(source, lang)
    assert {(d["kind"], d["qualified_name"]) for d in got[0]} == defs
    assert refs <= {(r["stream"], r["src"], r["name"]) for r in got[1]}
    assert all(r["name"] not in ("No", "no", "no2") for r in got[1])
    began = time.time()
    blocks.parse(source * (2_000_000 // len(source)), lang)
    assert time.time() - began < 20


@pytest.mark.parametrize("lang", CODE)
def test_any_text_parses(lang):
    r = random.Random(3)
    words = ["end", "def", "class", "function", "{", "}", "(", ")", "begin", "is", "if", "do", "x", "y", "\n", ";", "'", '"', "<", ":", ".", "procedure", "package", "--", "#", "/*", "é"]
    for _ in range(300):
        blocks.parse(" ".join(r.choice(words) for _ in range(r.randrange(30))), lang)


def test_languages_by_suffix(spark):
    from weftgraph.sources import files

    rows = frame(spark, [(f"a.{s}",) for s in ("rb", "lua", "sh", "scala", "php", "swift", "pks", "pkb", "prc", "fnc", "trg", "pls", "zzz")], "file string").select("file", files.dispatch(files.F.col("file")).alias("d"))
    assert {r["d"] for r in rows.where("file <> 'a.zzz'").collect()} == {"code"} and rows.where("file = 'a.zzz'").first()["d"] == "other"


# ---- XML

CONFIG = """<?xml version="1.0"?>
<!DOCTYPE configuration>
<configuration>
  <appSettings>
    <add key="Timeout" value="30"/>
    <add key="ApiPassword" value="hunter2"/>
    <add name="Main" value="Server=x;Pwd=y"/>
    <add name="Db" connectionString="Server=z"/>
    <add key="Blob" value="%s"/>
  </appSettings>
  <Retries>5</Retries>
  <c:note xmlns:c="x">a &lt; b</c:note>
</configuration>
""" % ("Ab1" * 20)


def test_configuration_keys_and_secrets():
    got = [(r["name"], r["value"], r["hidden"], r["line"]) for r in xmlread.config_keys(CONFIG)]
    assert got == [("Timeout", "30", False, 5), ("ApiPassword", None, True, 6), ("Main", None, True, 7), ("Db", None, True, 8), ("Blob", None, True, 9), ("Retries", "5", False, 11), ("note", "a < b", False, 12)]
    assert [r["name"] for r in xmlread.config_keys("<a>1</a><b>2</b><c>")] == ["a", "b"]
    assert xmlread.config_keys('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>') == [] and xmlread.config_keys("no xml") == [] and xmlread.config_keys("<a>" * 100_000) == []
    began = time.time()
    assert len(xmlread.config_keys("<r>\n" + '<add key="k" value="v"/>\n' * 80_000 + "</r>")) == 80_000
    assert time.time() - began < 12


def test_configuration_and_decisions_are_indexed(spark):
    rows = [("web.config", "xml", CONFIG), ("docs/adr/0001-use-x.md", "markdown", "# 1. Use X\n\nStatus: Accepted\n"), ("docs/other.md", "markdown", "# No\n"), ("pom.xml", "xml", "<project/>"), ("null.xml", "xml", None)]
    files = frame(spark, rows, "file string, lang string, content string")
    found = {(r["kind"], r["name"]) for r in extract.definitions(files).where("kind <> 'file'").collect()}
    assert ("adr", "Use X") in found and ("config_key", "Retries") in found and len(found) == 8
    assert [tuple(r) for r in extract.decisions(files).collect()] == [("docs/adr/0001-use-x.md", "markdown", "Use X", "accepted", 1)]
    assert xmlread.config(files).where("hidden and value is not null").count() == 0 and xmlread.config(files).count() == 7


def pom_of(artifact, parent=None, version=None, properties=(), managed=(), wanted=()):
    dep = lambda d: "<dependency><groupId>g</groupId><artifactId>%s</artifactId>%s%s</dependency>" % (d[0], f"<version>{d[1]}</version>" if d[1] else "", "".join(d[2:]))
    up = f"<parent><groupId>g</groupId><artifactId>{parent}</artifactId><version>1</version></parent>" if parent else "<groupId>g</groupId>"
    return f"<project>\n{up}\n<artifactId>{artifact}</artifactId>{f'<version>{version}</version>' if version else ''}<properties>{''.join(f'<{k}>{v}</{k}>' for k, v in properties)}</properties><dependencyManagement><dependencies>{''.join(map(dep, managed))}</dependencies></dependencyManagement><dependencies>{''.join(map(dep, wanted))}</dependencies></project>"


def test_maven_versions_are_inherited(spark):
    files = [
        ("top/pom.xml", pom_of("top", None, "1", [("lib.version", "${major}.5"), ("major", "2"), ("loop", "${loop}")], [("lib", "${lib.version}"), ("junit", "4")])),
        ("mid/pom.xml", pom_of("mid", "top", "1", [("major", "3")], [("junit", "5")])),
        ("leaf/pom.xml", pom_of("leaf", "mid", None, (), (), [("lib", None), ("junit", None, "<scope>test</scope>"), ("own", "${project.version}"), ("none", None), ("odd", "${loop}"), ("new", "9", "<optional>true</optional>")])),
        ("a/pom.xml", pom_of("a", "b", "1", (), [("x", "1")], [("x", None), ("y", None)])),
        ("b/pom.xml", pom_of("b", "a", "1", (), [("y", "2")], [("x", None)])),  # a circle
        ("lost/pom.xml", pom_of("lost", "unknown", "1", (), (), [("z", None)])),
        ("bad/pom.xml", "<project><artifactId>q"),
        ("null/pom.xml", None),
    ]
    got = {(r["file"].split("/")[0], r["project"], r["package"]): (r["constraint"], r["group"]) for r in xmlread.maven_dependencies(frame(spark, files, "file string, content string")).collect()}
    leaf = {k[2].split(":")[1]: v for k, v in got.items() if k[0] == "leaf"}
    assert leaf == {"lib": ("3.5", "runtime"), "junit": ("5", "dev"), "own": ("1", "runtime"), "none": (None, "runtime"), "odd": ("${loop}", "runtime"), "new": ("9", "optional")}
    assert got[("a", "g:a", "g:x")][0] == "1" and got[("a", "g:a", "g:y")][0] == "2" and got[("b", "g:b", "g:x")][0] == "1" and got[("lost", "g:lost", "g:z")][0] is None and len(got) == 10


def test_nodes_of_an_indexed_tree_do_not_clash(spark):
    """The class ids of these two files have the same eight first digits."""
    tree = frame(spark, [(f, "python", "class C:\n    pass\n") for f in ("f8581.py", "f16210.py")], "file string, lang string, content string")
    nodes, edges, _ = extract.index_repo(tree, "r")
    assert nodes.where("kind = 'class'").count() == 2 and edges.where("relation = 'contains'").count() == 2
