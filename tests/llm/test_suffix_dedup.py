import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import queries, suffix_dedup


def brute(rows, span=50):
    first: dict = {}
    for d, b in sorted(((d, (t or "").encode()) for d, t in rows if d is not None), key=lambda x: x[0]):
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1) if d is not None else ():
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed):
    r, rows = random.Random(seed), []
    noise = lambda n, a="abcdefghijklmnop é": "".join(r.choice(a) for _ in range(n))
    passages = [noise(r.choice([49, 50, 51, 60, 120, 300])) for _ in range(12)]
    for i in range(200):
        t = noise(r.randrange(0, 150))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 55))
            t += p[a : a + r.choice([49, 50, 52, 80, 400])] + noise(r.randrange(0, 70))
        rows.append((i, t))
    rows += [(400, "a" * 500), (401, "a" * 60), (402, "ab" * 300), (403, "ab" * 40 + "a" * 80), (404, None), (405, ""), (406, "a" * 700)]
    return rows + [(None, rows[5][1]), (7, "z" * 70), (7, rows[8][1]), (500, "z" * 70), (501, rows[5][1]), (501, rows[5][1])]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, marks int")


@pytest.mark.parametrize("seed", [1, 2])
def test_find_repeats_equals_brute_force(spark, seed):
    rows = fixture(seed)
    assert sorted((tuple(r)[:5] for r in suffix_dedup.find_repeats(docs_of(spark, rows)).collect()), key=str) == brute(rows)


def test_buckets_smaller_than_groups(spark):
    """A group of equal anchors that spans many buckets."""
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh ") for _ in range(220))
    rows = [(i, base[: 150 + i % 50] + str(i) + base[100 - i % 40 :]) for i in range(120)]
    docs = docs_of(spark, rows)
    marks = suffix_dedup.find_marks(docs, chunk=16)
    got = suffix_dedup._with_marks(docs, marks).collect()
    removed = {}
    for g in got:
        own = g["_marks"] and tuple(np.array([m[k] for m in g["_marks"]]) for k in ("check", "ident", "marks"))
        a, b = suffix_dedup._runs(g["text"].encode(), own)
        removed[g["doc_id"]] = (int((b - a).sum()), len(a))
    assert removed == {d: (n, s) for d, _, n, s, _ in brute(rows)}


def test_hot_anchors_in_halves(spark):
    """Every anchor dealt by the longer keys."""
    rows = fixture(5)
    docs = docs_of(spark, rows)
    got = suffix_dedup._with_marks(docs, suffix_dedup.find_marks(docs, chunk=64, hot=1)).collect()
    removed = []
    for g in got:
        own = g["_marks"] and tuple(np.array([m[k] for m in g["_marks"]]) for k in ("check", "ident", "marks"))
        a, b = suffix_dedup._runs((g["text"] or "").encode(), own)
        removed.append((g["doc_id"], int((b - a).sum()), len(a)))
    assert sorted(removed, key=str) == sorted(((d, n, s) for d, _, n, s, _ in brute(rows)), key=str)


def test_long_texts(spark):
    """Texts above 50 kB that share some passages, and runs of one sign."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n))
    base = noise(60_000)
    rows = [(1, base), (2, noise(30_000) + base[20_000:21_000] + noise(30_000)), (3, " " * 60_000), (4, base[:100] + " " * 3000), (5, noise(55_000))]
    assert sorted((tuple(x)[:5] for x in suffix_dedup.find_repeats(docs_of(spark, rows)).collect()), key=str) == brute(rows)


def test_sort_bucket_is_exact():
    r = np.random.default_rng(3)
    base = r.integers(97, 100, suffix_dedup._SLOT, dtype=np.uint8)
    slots = np.tile(base, (80, 1))
    for s in slots:
        at = r.integers(0, suffix_dedup._SLOT, 2)
        s[at[(at < suffix_dedup._REACH) | (at >= suffix_dedup._REACH + suffix_dedup.GRAM)]] = 120
    docs = r.integers(0, 30, 80)
    edges = np.tile([0, suffix_dedup._STARTS], (80, 1))
    marks = suffix_dedup.sort_bucket(slots, docs, edges)
    for k in range(suffix_dedup._STARTS):
        own = [s[k : k + 50].tobytes() for s in slots]
        for i in range(80):
            want = any(own[j] == own[i] and docs[j] < docs[i] for j in range(80))
            assert bool((marks[i] >> k) & 1) == want


def test_drop_repeats_keeps_columns(spark):
    rows = fixture(1)
    out = suffix_dedup.drop_repeats(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "marks"]
    want = sorted(((d, n - k) for d, n, k, _, _ in brute(rows)), key=str)
    got = out.collect()
    assert all(r["key"] == "clash" and r["marks"] == 1 for r in got)
    assert sum(len(r["text"].encode()) for r in got) <= sum(n for _, n in want)
    assert suffix_dedup.find_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_op2_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op2_suffix_dedup(spark, sf).collect()), key=str) == brute(rows)
