import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_documents import brute as near_brute
from weftgraph.llm import packing, shared


def stages(spark, docs, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.table(stage(spark, docs, sf), "test-stage")
        out.append(docs)
    return out


def test_stages_take_effect(spark, sf):
    docs = shared.documents(spark, sf)
    tox, near, cut, clean, packed = stages(spark, docs, sf)
    assert all(x.columns == docs.columns for x in (tox, near, cut, clean))
    text = {r["doc_id"]: r["text"] for r in tox.collect()}
    kept = {d for d, _, c in near_brute(sorted(text.items())) if d == c}
    assert {r["doc_id"] for r in near.collect()} == kept
    before = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert before.keys() == kept
    first = {}
    for d, t in sorted(before.items()):
        b = t.encode()
        own = {b[i : i + 50] for i in range(len(b) - 49)}
        assert not any(first.get(s, d) < d for s in own) or text[d] != t
        for s in own:
            first.setdefault(s, d)
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert after.keys() == kept and not any("@mail" in t for t in after.values())
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == kept
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in after.items()}


def test_run_equals_stages_and_edges(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"] and got.count() > 0
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "scum " * 3000, "z"), (None, "no id", "n"), (3, "twice", "z")], "doc_id long, text string, class string")
    *_, packed = stages(spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} >= {1, 2, None}
    assert stages(spark, docs.limit(0), sf)[-1].count() == 0


def test_near_duplicates_are_judged_by_row(spark, sf):
    say = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, say("a"), "first"), (2, say("a"), "copy"), (2, say("b"), "clean, id of a copy"), (7, say("c"), "one"), (7, say("d"), "two, same id")]
    rows += [(None, say("e"), "no id"), (None, say("e"), "no id"), (None, say("a"), "copy without id"), (9, None, "empty"), (None, "", "empty")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, class string"), sf)
    assert got.columns == ["doc_id", "text", "class"]
    assert sorted(r["class"] for r in got.collect()) == ["clean, id of a copy", "empty", "empty", "first", "no id", "one", "two, same id"]
