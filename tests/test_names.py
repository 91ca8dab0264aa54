"""Names in texts against ``\\bname\\b``, and the stream of shards."""

import random
import re

from weftgraph.operators import names, text
from weftgraph.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute(docs, known):
    return sorted({(d, n) for d, t in docs for n in known if n and t and re.search(r"\b" + re.escape(n) + r"\b", t)})


def test_names_equal_word_boundaries(spark, monkeypatch):
    monkeypatch.setattr(names, "PART", 4)  # so that there are several automata
    r = random.Random(6)
    parts = ["a", "b2", "charge", "order", "_", ".", "-", "/", "::", "+", "(", " ", "é", "naïve", "日本", "x_y"]
    make = lambda n: "".join(r.choice(parts) for _ in range(r.randrange(1, n)))
    known = [make(8) for _ in range(60)] + ["a1.b2.c3.d4.e5.f6.g7", "", "operator+", "+x"]
    docs = [(i, " ".join([make(6), r.choice(known), make(6)])) for i in range(150)] + [(1000, None), (1001, ""), (1002, "see a1.b2.c3.d4.e5.f6.g7, not xa1.b2.c3.d4.e5.f6.g7"), (1003, "a " * 50_000)]
    got = names.names_in(frame(spark, docs, "doc_id long, text string"), frame(spark, [(n,) for n in known + known], "name string"))
    assert sorted(tuple(x) for x in got.collect()) == brute(docs, known)


def test_mentions_have_no_longest_name(spark):
    symbols = frame(spark, [("n1", "a1.b2.c3.d4.e5.f6.g7", "class"), ("n2", "charge", "class"), ("n3", "charge", "function"), ("n4", "ab", "class")], "node_id string, name string, kind string")
    docs = frame(spark, [(1, "a1.b2.c3.d4.e5.f6.g7"), (2, "charge_order"), (3, "charge-order ab")], "doc_id long, text string")
    assert sorted(tuple(r) for r in text.mentions(docs, symbols).collect()) == [(1, "n1", "INFERRED"), (3, "n2", "AMBIGUOUS"), (3, "n3", "AMBIGUOUS")]
    assert sorted(tuple(r) for r in text.mentions(docs, symbols, ["class"]).collect()) == [(1, "n1", "INFERRED"), (3, "n2", "INFERRED")]


# ---- the stream of shards

SCHEMA = "repo_id string, head string, parser string, seq long, node_id string"


def stream(spark, folder, schema=SCHEMA, patience=3600):
    put = lambda rows: frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    run = lambda: incremental.index_stream(spark, str(folder / "in"), schema, str(folder / "out"), str(folder / "state"), str(folder / "cp"), patience).awaitTermination()
    held = lambda: sorted((r["repo_id"], r["node_id"]) for r in spark.read.parquet(str(folder / "out")).collect())
    return put, run, held


def test_decisions():
    cases = {(None, ("h", "p", 1)): "new", (("h", "p", 1), ("h", "p", 1)): "more", (("h", "p", 1), ("h", "p", 2)): "known", (("h", "p", 2), ("g", "p", 1)): "late", (("h", "p", 1), ("g", "p", 2)): "new", ((None, None, None), (None, None, None)): "more", (("h", None, 1), ("h", "p", 1)): "new", (("h", "p", 1), ("g", "p", None)): "late"}
    assert {k: incremental.decide(*k) for k in cases} == cases


def test_stream_keeps_rows_with_null_parser_and_equal_sites(spark, tmp_path):
    put, run, held = stream(spark, tmp_path)
    put([("r", "h", None, 1, "site"), ("r", "h", None, 1, "site"), ("s", None, "11", None, "x")])
    run()
    assert held() == [("r", "site"), ("r", "site"), ("s", "x")]
    put([("r", "h", None, 1, "site"), ("r", "h", None, 1, "more"), ("s", None, "11", None, "y")])  # a row come again, and the rest of the shards
    run()
    assert held() == [("r", "more"), ("r", "site"), ("r", "site"), ("s", "x"), ("s", "y")]
    state = {r["repo_id"]: (r["head"], r["parser"], r["seq"], r["status"]) for r in spark.read.parquet(str(tmp_path / "state")).collect()}
    assert state == {"r": ("h", None, 1, "open"), "s": (None, "11", None, "open")}


def test_stream_replayed_batch_leaves_the_same(spark, tmp_path):
    put, run, held = stream(spark, tmp_path)
    put([("r", "h1", "1", 1, "a"), ("q", "h1", "1", 1, "z")])
    run()
    put([("r", "h1", "1", 1, "b"), ("q", "h2", "1", 2, "y")])
    run()
    want = held()
    for left in ("1", ".1.crc"):  # the second batch was written but not told to be done
        (tmp_path / "cp" / "commits" / left).unlink(missing_ok=True)
    run()
    assert held() == want == [("q", "y"), ("r", "a"), ("r", "b")]


def test_shards_that_nothing_follows_are_settled(spark, tmp_path):
    put, run, held = stream(spark, tmp_path, patience=0)
    put([("r", "h1", "1", 1, "a")])
    run()
    put([("q", "h1", "1", 1, "z")])
    run()
    state = {r["repo_id"]: (r["n"], r["status"]) for r in spark.read.parquet(str(tmp_path / "state")).collect()}
    assert state["r"] == (1, "settled") and held() == [("q", "z"), ("r", "a")]


# ---- paged services as a stream


def test_pages_are_read_once(spark, tmp_path):
    import json

    from weftgraph.sources import paged, sinks

    sinks.register_sources(spark)

    def put(service, page, rows):
        folder = tmp_path / "in" / f"service={service}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("\n".join(json.dumps({"id": r, "user": {"name": None}}) for r in rows))

    def run():
        rows = spark.readStream.format("weft_pages").option("path", str(tmp_path / "in")).option("fields", "id=id;who=user.name").option("pages", "2").load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r["service"], r["page"], r["id"], r["who"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for n in range(3):
        put("a", n, [n, n])
    put("b c", 0, ["x"])
    put("b c", 2, ["waits"])
    first = run()
    assert first == [("a", n, str(n), None) for n in range(3) for _ in range(2)] + [("b c", 0, "x", None)]
    put("b c", 1, [])
    put("new", 0, ["y"])
    (tmp_path / "in" / "service=a" / "page=0" / "a.json").unlink()  # a page that was read is not asked for again
    assert run() == first + [("b c", 2, "waits", None), ("new", 0, "y", None)] == run()
    reader = paged.PagedReader({"path": str(tmp_path / "in"), "fields": "id=id", "pages": "2"})
    assert [p.value for p in reader.partitions({"a": 1}, {"a": 4, "b": 1})] == [("a", 1, 3), ("a", 3, 4), ("b", 0, 1)]


# ---- redaction and exports


def test_redaction(spark):
    said = "/home/me/ws/team/api/src/x.py of team/api, myteam/api, team/api.git; /home/me/other at git.corp.example"
    rows = frame(spark, [(1, said), (2, None), (3, "")], "id long, t string")
    out = rows.select("id", text.redact(rows["t"], ["team/api", "api", ""], {"/home/me": "<home>", "/home/me/ws": "<workspace>"}, {"git.corp.example": "<host>"}).alias("t"))
    got = {r["id"]: r["t"] for r in out.collect()}
    d = text.digest
    assert got == {1: f"<workspace>/{d('team/api')}/src/x.py of {d('team/api')}, myteam/{d('api')}, team/api.git; <home>/other at <host>", 2: None, 3: ""}
    under = frame(spark, [("/w/secret-repo/a.py",)], "t string")
    assert under.select(text.redact(under["t"], [], {"/w": "<workspace>"}).alias("t")).first()["t"] == f"<workspace>/{d('secret-repo/a.py')}"


def test_json_export_can_be_read_again(spark, monkeypatch):
    import json

    import pytest

    from weftgraph.operators import render

    n = frame(spark, [("a", 'x"<y>\n', None), ("b", "é", 3)], "node_id string, name string, line_start int")
    e = frame(spark, [("a", "b", "calls"), ("a", "b", "calls")], "src string, dst string, relation string")
    assert json.loads(render.to_json(n, e).first()["json"]) == {"nodes": [{"node_id": "a", "name": 'x"<y>\n', "line_start": None}, {"node_id": "b", "name": "é", "line_start": 3}], "edges": [{"src": "a", "dst": "b", "relation": "calls"}] * 2}
    assert json.loads(render.to_json(n.limit(0), e.limit(0)).first()["json"]) == {"nodes": [], "edges": []}
    monkeypatch.setattr(render, "MOST_LINES", 3)
    with pytest.raises(ValueError):
        render.to_json(n, e)
