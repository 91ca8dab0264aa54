"""The stored text index, two-sided paths, forward push, residual codes and the automaton of names, against brute force."""

import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import annindex, embed, pagerank, search, textindex, traverse


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NODES = "node_id string, name string, qualified_name string, file string"


def made_nodes(n, seed=1):
    r = random.Random(seed)
    words = ["store", "storage", "load", "loader", "test", "context", "meta", "auth", "x1", "a", "ab", "été"]
    name = lambda: "".join(r.choice(["_", " ", ".", ""]) + r.choice(words) for _ in range(r.randrange(1, 5)))
    return [(f"n{i}", name(), name(), r.choice([None, "src/" + r.choice(words) + ".py"])) for i in range(n)]


QUERIES = ["sto", "store load", "a", "Context", "nothing", "été", "", "store_"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    nodes = frame(spark, made_nodes(300), NODES)
    out = textindex.TextIndex(spark, str(tmp_path_factory.mktemp("index") / "t"), block_nodes=8)
    out.build(nodes)
    return out


def rows(df):
    return [(r["node_id"], r["name"], r["exact"], r["prefix"], round(r["score"], 3)) for r in df.collect()]


def scan(spark, nodes, q, k):
    """The scan's rows; a query without a term, or with a sign that no word holds, finds nothing."""
    return [] if not search.query_terms(q) or any(not t.isascii() or "_" in t for t in search.query_terms(q)) else rows(search.fts_bm25(nodes, q, k))


def test_index_equals_scan(spark, index):
    nodes = frame(spark, made_nodes(300), NODES)
    for q in QUERIES:
        assert rows(index.search(q, 5)) == scan(spark, nodes, q, 5), q


def test_index_reads_one_folder_and_few_blocks(spark, index):
    plan = index.prefix("postings", "term", "store")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(lead" in plan and "x7374" in plan and "PushedFilters" in plan
    terms, idf, average = index.statistics("store")
    bound = index.bounds(terms, idf, average)
    named = index.prefix("names", "lname", "zzz")
    assert index.blocks_for(terms, idf, average, named, 2).count() < bound.count() / 2
    best = {r["block"]: r["bound"] for r in bound.collect()}
    assert all(r["score"] <= best[r["block"]] + 1e-9 for r in index._score(terms, idf, average).collect())


def test_index_after_refresh_and_compaction(spark, tmp_path):
    old = made_nodes(120, 3)
    own = textindex.TextIndex(spark, str(tmp_path / "a"), block_nodes=8)
    own.build(frame(spark, old, NODES))
    new = {x[0]: x for x in old}
    for seed, gone in ((4, ["n1", "n2"]), (5, ["n30"])):
        changed = [x for x in made_nodes(160, seed) if int(x[0][1:]) % 3 == seed % 3 and x[0] not in gone]
        own.refresh(frame(spark, changed, NODES), frame(spark, [(x,) for x in gone], "node_id string"))
        new |= {x[0]: x for x in changed}
        for x in gone:
            new.pop(x, None)
    nodes = frame(spark, list(new.values()), NODES)
    whole = own.compact(str(tmp_path / "b"))
    want = scan(spark, nodes, "sto", 6)
    assert len(want) == 6 and rows(own.search("sto", 6)) == want and rows(whole.search("sto", 6)) == want


def test_index_of_nothing(spark, tmp_path):
    own = textindex.TextIndex(spark, str(tmp_path / "a"))
    own.build(frame(spark, [], NODES))
    assert rows(own.search("store")) == []
    own.refresh(frame(spark, [("n1", "store", None, None)], NODES))
    assert [r[0] for r in rows(own.search("store"))] == ["n1"]


def test_a_folder_of_most_names_is_dealt_to_tasks(spark, tmp_path):
    own = textindex.TextIndex(spark, str(tmp_path / "a"), block_nodes=8)
    nodes = [(f"n{i}", f"order_{i} order", None, None) for i in range(400)]
    own.build(frame(spark, nodes, NODES))
    own.refresh(frame(spark, [(a, b.upper(), c, d) for a, b, c, d in nodes[:200]], NODES))
    for what, text in (("names", "lname"), ("postings", "term")):
        each = own.prefix(what, text, "or").groupBy("gen", F.input_file_name()).count().groupBy("gen").agg(F.count("*"), F.max("count"), F.sum("count")).collect()
        assert len(each) == 2 and all(files > 1 and most < n for _, files, most, n in each), (what, each)
    assert [r["wtf"] for r in own.prefix("postings", "term", "order").where("gen = 0").select("wtf").distinct().collect()] == [20.0]


# ---- paths


def brute_path(pairs, start, end, hops):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    if start == end:
        return [start]
    if dist.get(end, hops + 1) > hops:
        return []
    path = [end]
    while path[-1] != start:
        path.append(min(y for y in near[path[-1]] if dist.get(y) == dist[path[-1]] - 1))
    return path[::-1]


def test_two_sided_paths_equal_brute_force(spark):
    r = random.Random(7)
    for n, m in ((30, 40),):
        pairs = [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)]
        e = frame(spark, pairs, "src string, dst string")
        for _ in range(4):
            a, b = f"v{r.randrange(n)}", f"v{r.randrange(n + 2)}"
            got = [x["node_id"] for x in traverse.shortest_path(e, a, b, 5).orderBy("step").collect()]
            assert got == brute_path(pairs, a, b, 5), (a, b)


def test_path_keeps_away_from_hubs(spark):
    """The side of the leaf grows while the other end is a hub."""
    pairs = [("hub", f"leaf{i}") for i in range(200)] + [("leaf7", "m"), ("m", "n"), ("n", "far")]
    got = [x["node_id"] for x in traverse.shortest_path(frame(spark, pairs, "src string, dst string"), "hub", "far").orderBy("step").collect()]
    assert got == ["hub", "leaf7", "m", "n", "far"]


# ---- personalized PageRank


def power(pairs, seeds, damping=0.5, rounds=200):
    """Power iteration; what nodes without edges hold goes back to the seeds."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ids = {*near, *seeds}
    positive = {v: max(0.0, s) for v, s in seeds.items()}
    total = sum(positive.values())
    p = {v: positive.get(v, 0) / total if total else (v in seeds) / len(seeds) for v in ids}
    r = dict(p)
    for _ in range(rounds):
        new = {v: (1 - damping) * p[v] for v in ids}
        for v in ids:
            for w in near.get(v, ()):
                new[w] += damping * r[v] / len(near[v])
            if v not in near:
                for w in ids:
                    new[w] += damping * r[v] * p[w]
        r = new
    return r


def test_forward_push_equals_power_iteration(spark, monkeypatch):
    monkeypatch.setattr(pagerank, "HUB", 4)  # so that hubs have several salts
    r = random.Random(2)
    queries = {1: ([(0, i) for i in range(1, 30)] + [(r.randrange(30), r.randrange(30)) for _ in range(20)], {0: 0.5, 3: 0.2}), 2: ([(1, 2), (2, 3)], {1: 1.0, 9: 1.0}), 3: ([], {5: -1.0, 6: 0.0})}
    pairs = frame(spark, [(q, a, b) for q, (e, _) in queries.items() for a, b in e], "query_id long, src long, dst long")
    seeds = frame(spark, [(q, v, s) for q, (_, own) in queries.items() for v, s in own.items()], "query_id long, id long, score double")
    got = pagerank.push(pairs, seeds, tolerance=1e-7).collect()
    assert {r["query_id"] for r in got} == {1, 2, 3}
    for q, (e, own) in queries.items():
        want, mine = power(e, own), {x["node_id"]: x for x in got if x["query_id"] == q}
        assert set(mine) == set(want)
        assert all(-1e-9 <= want[v] - x["score"] <= x["residual"] + 1e-9 and x["residual"] < 1e-4 for v, x in mine.items())


# ---- approximate neighbours


def clustered(n, dim=16, places=30, seed=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(places, dim))
    x = c[r.integers(places, size=n)] + 0.15 * r.normal(size=(n, dim))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_ann_reads_a_tenth_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(annindex, "SLICE", 40)  # lists in several slices, queries in several blocks
    monkeypatch.setattr(annindex, "BLOCK", 16)
    rows = clustered(1500)
    v = frame(spark, rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 50 = 0")
    index = annindex.AnnIndex(v)
    got = index.search(q, 10, 0.1).collect()
    x = np.array([r for _, r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(0, 1500, 50) for j in np.argsort(-s[i])[:10]}
    assert len(got) == 300 and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 270
    assert all(abs(r["score"] - s[r["query_id"], r["vec_id"]]) < 1e-4 for r in got)
    assert index.read_share(q, 0.1) < 0.13 and index.codes.count() == 1500
    assert annindex.n_lists(10**4) == 100 and annindex.n_lists(10**12) == annindex.MOST_LISTS


def test_read_share_counts_all_queries(spark, monkeypatch):
    rows = clustered(600)
    v = frame(spark, rows, "vec_id long, embedding array<float>")
    index = annindex.AnnIndex(v)
    monkeypatch.setattr(annindex, "SAMPLE", 3)
    sizes = {r["list"]: r["count"] for r in index.codes.groupBy("list").count().collect()}
    each = np.array([sizes.get(i, 0) for i in range(len(index.model.centres))])
    x = np.array([np.array(r, np.float32) for _, r in rows], float)
    near = np.argsort(-((x / np.linalg.norm(x, axis=1, keepdims=True)) @ index.model.centres.T), axis=1, kind="stable")[:, : index.probes(0.1)]
    assert abs(index.read_share(v, 0.1) - each[near].sum(1).mean() / 600) < 1e-9
    assert index.read_share(v.where("false"), 0.1) == 0.0


def test_all_lists_and_exact_ranks_find_all(spark):
    rows = clustered(120, seed=9)
    v = frame(spark, rows + [(500, [0.0] * 16), (501, rows[0][1])], "vec_id long, embedding array<float>")
    got = annindex.AnnIndex(v).search(v, 3, 1.0, refined=50).collect()
    want = search.knn_edges(v, 3).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got if r["query_id"] != 500) == sorted((r["src"], r["dst"]) for r in want if r["src"] != 500)


def test_codes_tell_neighbours_apart_in_narrow_and_in_wide_lists(spark):
    rng = np.random.default_rng(11)
    wide = rng.normal(size=(6000, 64))
    narrow = rng.normal(size=(24, 64))[np.arange(6000) % 24] + 0.02 * wide
    for x, share, refined in ((wide, 1.0, 5), (narrow, 0.2, 2)):
        v = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()})).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        q = v.where("vec_id % 100 = 0")
        found = embed.ann_topk(v, q, 10, share, refined)
        exact = search.knn_edges(v, 10, queries=q).withColumnRenamed("src", "query_id").withColumnRenamed("dst", "vec_id")
        assert embed.recall(found, exact) >= 0.9


def test_hybrid_ranking_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    edges = frame(spark, [(i, (i * 7 + 1) % 30) for i in range(30)], "src long, dst long").mapInPandas(work, "src long, dst long")
    got = search.hybrid_rank(edges, frame(spark, [(0, 1, 0.5), (0, 2, 0.25)], "query_id long, id long, score double"), 5)
    assert got.count() == 5 and made.value == 30


def test_nearest_others_with_ties():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(700, 16)), np.repeat(rng.normal(size=(2, 16)), 300, 0), rng.integers(-1, 2, size=(700, 4)).astype(float)):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x, ids = x / np.where(n == 0, 1, n), rng.permutation(10_000)[: len(x)]
        s = np.round(x @ x.T, 6)
        np.fill_diagonal(s, -9)
        want = sorted((int(q), int(i)) for q, o in zip(ids, np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :3]) for i in ids[o])
        assert sorted((int(a), int(b)) for a, b in zip(*search._best_of(x, ids, x, ids, 3)[:2])) == want
