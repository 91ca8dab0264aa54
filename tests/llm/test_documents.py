import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import exact_topk, fingerprints, parity_join, queries, toxicity
from weftgraph.llm import components as components_of
from weftgraph.llm.components import components, joined


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, class string, bucket int")


# ---- fingerprints


def next_of(rows):
    """Expected (doc_id, n_chars, sha of edited) without ties in doc_id."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = set()
    for i, (d, t) in enumerate(rows):
        n, nxt = len(t), rows[(i + 1) % len(rows)][1]
        out.add((d, n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 40])
def test_fingerprints_next_and_edges(spark, n):
    rows = [(3 * i, f"line {i}.\nsecond é line. third {i % 4}" * (i % 5)) for i in range(n)] + [(None, "no id. at all"), (1000, None)]
    out = fingerprints.fingerprint_documents(docs_of(spark, rows)).collect()
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out} == next_of(rows) and len(out) == len(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def test_fingerprints_ties_and_empty(spark):
    rows = [(1, "same text. here"), (1, "same text. here"), (1, "other"), (2, "same text. here")]
    out = fingerprints.fingerprint_documents(docs_of(spark, rows)).collect()
    assert len(out) == 4 and len({r["fingerprint"] for r in out}) == 2
    assert fingerprints.fingerprint_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_peeling_recovers_differences():
    r = random.Random(2)
    for n in (0, 1, 10, 400):
        a = [f"p{r.randrange(10**6)}" for _ in range(n)]
        b = a[: n // 2] + [f"q{i}" for i in range(n // 3)]
        da, db = fingerprints.digests("\n".join(a)), fingerprints.digests("\n".join(b))
        only_a, only_b = fingerprints.differing(da, db)
        assert set(only_a) == set(da.tolist()) - set(db.tolist()) and set(only_b) == set(db.tolist()) - set(da.tolist())


def test_op4_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op4_fingerprints(spark, sf).collect()
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out} == next_of(rows)
    text = dict(rows)
    prints = {}
    for r in out:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in out]) > np.mean([r["near_next"] for r in out]) + 0.15


def test_likeness_equals_the_share_of_paragraphs():
    """What the subtracted fingerprints say, against plain sets of digests."""
    r = random.Random(8)
    for n in (0, 1, 5, 60, 900):
        a = [f"p{r.randrange(2000)}" for _ in range(n)]
        b = [x for x in a if r.random() < 0.8] + [f"q{r.randrange(2000)}" for _ in range(r.randrange(n + 1))]
        da, db = fingerprints.digests("\n".join(a)), fingerprints.digests("\n".join(b))
        both, all_ = len(np.intersect1d(da, db)), len(np.union1d(da, db))
        got = fingerprints.likeness(da, db, (fingerprints.sketch(da), fingerprints.sketch(db)))
        assert got == (both / all_ if all_ else 1.0)
        assert abs(fingerprints.estimate(fingerprints.sketch(da, 3000), fingerprints.sketch(db, 3000)) - (all_ - both)) <= 0.25 * (all_ - both) + 3


def test_op4_likeness_on_documents(spark, sf):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    out = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, sf).collect()}
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 1.0
    for i, (d, t) in enumerate(rows):
        nxt, n = rows[(i + 1) % len(rows)][1], len(t)
        own, other, edited = (fingerprints.digests(x).tolist() for x in (t, nxt, t[: n - n // 2] + nxt[: n // 2]))
        assert out[d]["near_next"] == near(own, other) and out[d]["near_edited"] == near(own, edited)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50])
def test_buckets_count_cuts_below(spark, n):
    from pyspark.sql import functions as F

    cuts = [3 * i for i in range(n)]
    rows = spark.range(-2, 3 * n + 4)
    assert all(r["b"] == sum(c < r["id"] for c in cuts) for r in rows.select("id", fingerprints._bucket(F.col("id"), cuts).alias("b")).collect())


def test_fingerprints_of_long_texts(spark):
    text = "".join(f"Sentence number {i} stands here.\n" for i in range(3000))
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs_of(spark, [(1, text), (2, text.replace("number 7 ", "count 7 "))])).collect()}
    assert len(text) > 50_000 and out[1]["near_next"] == 2999 / 3001


# ---- exact top-k


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8).round(1)]) for i in range(230)]
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (350, rows[0][1]), (351, rows[0][1])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, score int")
    v = exact_topk.quantize(df)
    got = sorted(tuple(x) for x in exact_topk.top_k(v, v.where("vec_id % 50 = 0"), k=5, block=8, cell=50, query_cell=2).collect())
    q = {i: np.floor(np.array(e) * 256) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert exact_topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_prunes_blocks_of_sorted_vectors():
    """Vectors that lie near each other where their ids do: most blocks fall below the k-th score, and a floor spares more."""
    r = np.random.default_rng(2)
    v = np.repeat(r.integers(-200, 200, (40, 16)), 64, axis=0) + r.integers(-3, 4, (40 * 64, 16))
    ids, q, scored = np.arange(len(v)), v[::97], []
    a = exact_topk.search(ids, v, ids[::97], q, 5, 64, scored=scored)
    want = [np.sort((v @ x)[ids != i])[::-1][:5] for i, x in zip(ids[::97], q)]
    assert a[2].reshape(-1, 5).tolist() == [w.tolist() for w in want] and scored[0] < 0.25 * scored[1]
    floors, more = np.array([int(w[4]) for w in want], dtype=object), []
    assert [x.tolist() for x in exact_topk.search(ids, v, ids[::97], q, 5, 64, floors, more)] == [x.tolist() for x in a] and more[0] <= scored[0]


def test_topk_with_repeated_rows_and_ids(spark):
    rows = [(1, [3.0, 1.0])] * 9 + [(2, [1.0, 1.0]), (2, [5.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, None)]
    v = exact_topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in exact_topk.top_k(v, v.where("vec_id = 50"), k=3, block=2, cell=4, query_cell=1).orderBy("rank").collect()]
    assert got == [(50, 1, 2, 5 * 65536), (50, 2, 1, 3 * 65536), (50, 3, 1, 3 * 65536)]


def test_topk_large_components():
    v = np.array([[1 << 40, 1], [-(1 << 40), 3]], dtype=object)
    q, i, s = exact_topk.search(np.array([1, 2]), v, np.array([9]), np.array([[2, 5]], dtype=object), 2, 1)
    assert s.tolist() == [(1 << 41) + 5, -(1 << 41) + 15]


def test_quantize_keeps_vectors_below_the_stated_limit(spark):
    rows = [(1, [2.0**53, 1.0]), (2, [-(2.0**53), 1.0]), (3, [2.0**54, 1.0]), (4, [1.0, -(2.0**54)])]
    got = {r["vec_id"]: r["q"] for r in exact_topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: [2**61, 256], 2: [-(2**61), 256]} and "2**62 / scale" in exact_topk.__doc__ and "2**62 / scale" in exact_topk.quantize.__doc__


def test_op5_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op5_exact_topk"]).fetchall())
    assert sorted(tuple(r) for r in queries.op5_exact_topk(spark, sf).collect()) == want


def test_topk_floors_are_exact_beyond_doubles(spark):
    """A query that has no floor, as its id has two vectors, stands beside one whose floor is no double."""
    big = 2**53 + 3
    values = {1: big, 2: 5, 3: big - 2, 4: 7, 5: 9, 6: big - 1}
    candidates = spark.createDataFrame([(v, [x]) for v, x in values.items()], "vec_id long, q array<long>")
    asked = spark.createDataFrame([(0, [1]), (50, [1]), (50, [2])], "vec_id long, q array<long>")
    for k in (1, 2):
        got = {(r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(candidates, asked, k, block=1, cell=2).collect() if r["query_id"] == 0}
        best = sorted(values.items(), key=lambda p: (-p[1], p[0]))[:k]
        assert got == {(i + 1, v, x) for i, (v, x) in enumerate(best)}


# ---- toxicity


def toxic_fixture(n=600):
    r = random.Random(3)
    texts, grades = [], []
    for i in range(n):
        g = i % 3
        words = [f"w{r.randrange(400)}x" for _ in range(60)]
        for _ in range(2 if g else 0):
            words[r.randrange(60)] = r.choice(["idiot", "scum"] if g == 1 else ["vermin", "filth"])
        texts.append(" ".join(words).replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f"))
        grades.append(g)
    return texts, grades


def test_ordinal_held_out_accuracy():
    texts, grades = toxic_fixture()
    m = toxicity.fit(texts[:400], grades[:400])
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    above = m.at_least(m.scores(texts[400:]))
    likely = np.argmax(np.column_stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]]), axis=1)
    assert (likely == np.array(grades[400:])).mean() > 0.9
    severity = above.sum(1)
    assert severity[np.array(grades[400:]) == 2].mean() > severity[np.array(grades[400:]) == 1].mean() > severity[np.array(grades[400:]) == 0].mean()


def test_toxicity_fit_is_the_likeliest_model():
    """The fitted thresholds and weights against a search for the least penalised loss, on a table of three grades and three words."""
    counts = {("calm",): (30, 6, 2), ("vile",): (8, 20, 6), ("scum",): (3, 7, 25), ("calm", "scum"): (6, 9, 8), ("vile", "scum"): (1, 4, 15), (): (12, 7, 5)}
    rows = [(words, grade) for words, per in counts.items() for grade, k in enumerate(per) for _ in range(k)]
    names, l1, l2 = ["calm", "scum", "vile"], 2e-4, 2e-4
    x = np.array([[w in words for w in names] for words, _ in rows], float)
    y = np.array([g for _, g in rows])
    weight = (len(y) / (3 * np.bincount(y)))[y]

    def loss(p):
        if p[1] <= p[0]:
            return np.inf
        cdf = 1 / (1 + np.exp(-(np.array([-60, p[0], p[1], 60])[None, :] - (x @ p[2:])[:, None])))
        at = np.arange(len(y))
        return -(weight * np.log(cdf[at, y + 1] - cdf[at, y])).sum() / len(y) + l2 / 2 * (p[2:] ** 2).sum() + l1 * np.abs(p[2:]).sum()

    best, step = np.array([-1.0, 1.0, 0.0, 0.0, 0.0]), 1.0
    while step > 1e-6:
        near = min((best + s * step * e for e in np.eye(5) for s in (1, -1)), key=loss)
        best, step = (near, step) if loss(near) < loss(best) else (best, step / 2)
    m = toxicity.fit([" ".join(w) for w, _ in rows], y.tolist(), least=1, clear=0.0, l1=l1, l2=l2)
    got = np.array([*m.thresholds, *(m.weights[w] for w in names)])
    assert loss(got) <= loss(best) + 1e-4
    assert np.abs(got - best).max() < 0.05 and got[0] < got[1]
    above = m.at_least(m.scores(["calm", "scum vile"]))
    assert np.allclose(above, 1 / (1 + np.exp(best[None, :2] - np.array([best[2], best[3] + best[4]])[:, None])), atol=0.02)


def test_texts_without_words_are_never_toxic(spark):
    """Also where the prior alone would reject them; a text with any word is judged by the model."""
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- \n"), (4, "scum"), (5, "fine"), (6, "7 " * 60000)], "doc_id long, text string")
    model = toxicity.OrdinalModel([-1.0], {"scum": 2.0, "fine": -4.0})
    got = {r["doc_id"]: (r["is_toxic"], r["p_toxic"] >= 0.5) for r in toxicity.score(docs, model).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, True), 4: (True, True), 5: (False, False), 6: (False, True)}
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} == {1, 2, 3, 5, 6}


def test_toxicity_edges(spark):
    texts, grades = toxic_fixture(300)
    docs = docs_of(spark, [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "scum"), (902, "scum idiot"), (902, "scum idiot")])
    labels = spark.createDataFrame([(i, min(g, 1)) for i, g in enumerate(grades)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=100)
    out = toxicity.score(docs, model, keep=("class",)).collect()
    assert len(out) == 305 and out[0]["class"] == "clash"
    got = [(r["doc_id"], r["is_toxic"]) for r in out[300:]]
    assert got == [(900, False), (901, False), (None, True), (902, True), (902, True)]
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert not any(r["is_toxic"] for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", "is_toxic").collect()
    hit = sum(r["toxic"] and r["is_toxic"] for r in held)
    assert hit >= 0.85 * sum(r["toxic"] for r in held)
    assert sum(not r["toxic"] and r["is_toxic"] for r in held) <= 0.01 * len(held)


# ---- near duplicates


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for i, s in enumerate(sets):
        shared: dict = {}
        for g in s:
            for j in where.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            where.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_rows(seed=4):
    r, rows = random.Random(seed), []
    for _ in range(60):
        n = r.choice([2, 5, 6, 7, 8, 9, 10, 12, 20, 40, 150, 400])
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(99)) for _ in range(n)]
        for _ in range(r.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(r.randrange(0, max(2, n // 25 + 2))):
                w[r.randrange(len(w))] = f"X{r.randrange(9)}"
            if r.random() < 0.4:
                w = w[: int(len(w) * r.uniform(0.72, 1))]
            if r.random() < 0.3:
                w = w + [f"y{r.randrange(999)}" for _ in range(r.randrange(n // 3 + 1))]
            rows.append((len(rows), " ".join(w)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9004, "ONE"), (9005, "é\x0bx"), (9006, "Éx")]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = sorted(tuple(r) for r in parity_join.near_duplicates(docs_of(spark, rows)).collect())
    assert got == brute(rows)


def test_near_duplicates_null_ids_and_empty(spark):
    docs = docs_of(spark, [(None, "a b c d e f g h i j k l m n o p"), (7, "a b c d e f g h i j k l m n o q"), (None, None)])
    got = {tuple(r) for r in parity_join.near_duplicates(docs).collect()}
    assert got == {(None, 12, 7), (7, 12, 7), (None, 0, None)}
    assert parity_join.near_duplicates(docs.limit(0)).count() == 0


def test_parity_keys_find_every_pair():
    r = np.random.default_rng(7)
    for n in [3, 4, 5, 8, 11, 20, 33, 64, 100, 257, 700]:
        for _ in range(60):
            pool = np.unique(r.integers(0, 2**63, 4 * n, dtype=np.uint64))
            a = np.sort(pool[:n])
            d = int(r.integers(0, n // 3 + 1))
            b = np.sort(np.concatenate([a[d // 2 :], pool[n : n + d - d // 2]]))
            if parity_join.linked(a, b, 3, 4) and len(a) + len(b) and not np.array_equal(a, b):
                assert set(parity_join.parity_keys(a)) & set(parity_join.parity_keys(b)), (n, d)


def test_components_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_components_joined_by_further_links(spark):
    """Links within a component change nothing, links between two rename the larger one, and their ends need not be known; only these are worked on."""
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (21, 22), (30, 31)]
    more = [(1, 3), (22, 11), (5, 31), (50, 51), (51, 3), (21, 20)]
    label = components(frame(first))
    got = sorted(tuple(r) for r in joined(label, frame(more)).collect())
    assert got == sorted(tuple(r) for r in components(frame(first + more)).collect())
    assert sorted(tuple(r) for r in joined(label, frame([])).collect()) == sorted(tuple(r) for r in label.collect())
    assert sorted(tuple(r) for r in joined(components(frame([])), frame(first)).collect()) == sorted(tuple(r) for r in label.collect())


def test_components_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(components_of, "_FEW", 3)
    test_components_chain_and_hub(spark)
    test_components_joined_by_further_links(spark)


def test_ids_tell_how_long_sketches_are(spark):
    """Sizes of cells are told from the ids, without a join with the sketches."""
    rows = [(n, " ".join(f"w{i}" for i in range(n + 4))) for n in (1, 2, 31, 32, 33, 63, 64, 255, 256, 257, 511, 512, 1023, 1024, 1500)]
    held = parity_join.sets_of(spark.createDataFrame(rows, "doc_id long, text string"))
    for bits in ("bits", "fine"):
        assert held.where(F.length(bits) != parity_join._sketch_bytes(F.col("class"), bits)).count() == 0


def test_op8_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op8_jaccard_join(spark, sf).collect()) == brute(rows)


def test_training_rows_are_cut_to_the_sample(spark):
    docs = docs_of(spark, [(7, f"text {i}") for i in range(500)] + [(i, f"w{i}") for i in range(100, 140)])
    labels = spark.createDataFrame([(7, 1), *((i, 0) for i in range(100, 140))], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, sample=5).collect()
    assert sorted(r["grade"] for r in rows) == [0] * 5 + [1]
    assert rows and {r["doc_id"] for r in rows if r["grade"]} == {7}


def test_score_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "scum idiot", 5, "x", "y"), (2, None, 6, "x", "y")], "doc_id long, text string, grade int, _text string, `a.b` string")
    model = toxicity.OrdinalModel([1.0], {"scum": 4.0})
    out = toxicity.score(docs, model, keep=tuple(docs.columns)).collect()
    assert [(r["doc_id"], r["grade"], r["_text"], r["a.b"], r["text"]) for r in out] == [(1, 1, "x", "y", "scum idiot"), (2, 0, "x", "y", None)]
    assert toxicity.drop_toxic(docs, model).collect() == docs.where("doc_id = 2").collect()


def test_keep_one_judges_rows_by_text(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(7, base, 1), (7, "an unrelated text under the same id as another one", 2), (8, base + " more", 3), (None, base, 4), (None, None, 5), (None, None, 5), (9, "  ", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted(tuple(r) for r in parity_join.keep_one(docs).select("row").collect())
    assert got == [(1,), (2,), (5,), (5,), (6,)]


def test_hot_group_of_sketches_meets_in_cells(spark, monkeypatch):
    """Many texts that share a passage without being near duplicates, and a few that are, with cells of a few rows each."""
    monkeypatch.setattr(parity_join, "_CELL", 512)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage + [f"x{r.randrange(10**6)}" for _ in range(12)])) for i in range(60)]
    rows += [(100 + i, t + " tail") for i, t in rows[:10]]
    assert sorted(tuple(x) for x in parity_join.near_duplicates(docs_of(spark, rows)).collect()) == brute(rows)


def test_a_task_gives_each_class_one_nearest_partner(spark):
    """Forty near copies that meet under ten keys: a task's rows are its classes, not its keys or pairs, and the copies still join."""
    r = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, f"x{r.randrange(10**6)}"])) for i in range(40)]
    held = parity_join.sets_of(spark.createDataFrame(rows, "doc_id long, text string"))
    sketches = held.select("class", "n", "bits", "fine")
    met = held.select("class", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("key"), F.col("class").alias("part"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert parity_join._cells(met, sketches, "fine", "nearest", 3, 4).count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(tuple(x) for x in parity_join.near_duplicates(docs_of(spark, rows)).collect()) == brute(rows)


def test_long_texts(spark):
    """Texts above 50 kB, alike and not."""
    r = random.Random(5)
    words = [f"v{r.randrange(10**5)}" for _ in range(20_000)]
    near = [w if i % 50 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))]
    assert sorted(tuple(x) for x in parity_join.near_duplicates(docs_of(spark, rows)).collect()) == brute(rows)


def test_sets_that_share_a_class_each_get_a_sketch():
    seen: set[int] = set()
    classes, checks = np.array([5, 5, -7, 5], np.int64), np.array([1, -1, 1, 1], np.int64)
    assert parity_join.met_before(seen, classes, checks) == [False, False, False, True]
    assert parity_join.met_before(seen, classes, checks) == [True] * 4
