import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from weftgraph.llm import queries, zorder_layout
from weftgraph.llm.zorder_layout import DOCUMENTS, Dimension, Layout


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    monkeypatch.setattr(zorder_layout, "_RANGES", 5)


def low(v):
    return (0, b"") if v is None else (1, v.encode() if isinstance(v, str) else v)


def brute(rows, layout):
    """rows: (key, value, ...); the contract's columns by its words."""
    n, names = len(rows), [d.name for d in layout.dimensions]
    side = 1 << layout.bits
    coords = []
    for k in range(len(names)):
        order = sorted(low(r[k + 1]) for r in rows)
        first = {}
        for i, v in enumerate(order):
            first.setdefault(v, i)
        coords.append([side * first[low(r[k + 1])] // n for r in rows])
    cells = list(zip(*coords)) if rows else []
    z = []
    for c in cells:
        at, out = dict(zip(names, c)), 0
        for bit in range(layout.bits - 1, -1, -1):
            for name in layout.interleaved:
                out = out << 1 | at[name] >> bit & 1
        z.append(out)
    order = sorted(range(n), key=lambda i: (z[i], low(rows[i][0])))
    position = {i: p for p, i in enumerate(order)}
    held = defaultdict(list)
    for i in range(n):
        held[position[i] // layout.rows_per_file].append(cells[i])
    bounds = {f: [(min(c[k] for c in own), max(c[k] for c in own)) for k in range(len(names))] for f, own in held.items()}
    reach = [d.reach for d in layout.dimensions]
    out = []
    for i in range(n):
        touched = sum(all(a <= q + r and b >= q - r for (a, b), q, r in zip(x, cells[i], reach)) for x in bounds.values())
        matching = sum(any(all(abs(c - q) <= r for c, q, r in zip(x, cells[i], reach)) for x in set(own)) for own in held.values())
        f = position[i] // layout.rows_per_file
        out.append((rows[i][0], z[i], position[i], f, touched, matching, ",".join(f"{a},{b}" for a, b in bounds[f])))
    return out


def of(df):
    return [(r[0], r["z"], r["position"], r["file"], r["files_touched"], r["files_matching"], r["file_bounds"]) for r in df.collect()]


def by_position(rows):
    return sorted(rows, key=lambda r: r[2])


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, text string, z string, file int")


def made(n, seed=1):
    r = random.Random(seed)
    sources = ["src0"] * 8 + [f"src{i}" for i in range(12)] + [None, "é", "z", "\U0001f600", "￿"]
    rows = [(i, r.choice(sources), r.choice(["en", "en", "de", None]), r.choice([None, "", "é" * r.randrange(40), "x" * r.randrange(3000), "same text"])) for i in range(n)]
    r.shuffle(rows)
    return rows


def values(rows):
    return [(d, s, g, -1 if t is None else len(t.encode()), None if d is None else zlib.crc32(str(d).encode()) % 365) for d, s, g, t in rows]


@pytest.mark.parametrize("per_file, n", [(500, 1200), (7, 400), (1, 60)])
def test_layout_equals_brute_force(spark, per_file, n):
    layout = Layout(DOCUMENTS.dimensions, DOCUMENTS.interleaved, rows_per_file=per_file)
    rows = made(n)
    got = of(zorder_layout.place(zorder_layout.document_values(docs_of(spark, rows)), layout))
    assert by_position(got) == by_position(brute(values(rows), layout))


def test_files_inside_one_cell(spark):
    rows = [(i, "only", "en", "t") for i in range(900)] + [(i, None, None, None) for i in range(900, 960)]
    layout = Layout(DOCUMENTS.dimensions, DOCUMENTS.interleaved, rows_per_file=9)
    got = of(zorder_layout.place(zorder_layout.document_values(docs_of(spark, rows)), layout))
    assert by_position(got) == by_position(brute(values(rows), layout))


def test_repeated_and_null_ids(spark):
    rows = made(80) + [(5, "a", "en", "x"), (5, "a", "en", "x"), (None, "b", "de", "y"), (None, "b", "de", "y")]
    layout = Layout(DOCUMENTS.dimensions, DOCUMENTS.interleaved, rows_per_file=10)
    got = of(zorder_layout.place(zorder_layout.document_values(docs_of(spark, rows)), layout))
    assert by_position(got) == by_position(brute(values(rows), layout))


def test_other_dimensions(spark):
    r = random.Random(4)
    layout = Layout([Dimension("a", False, 1), Dimension("b", True, 0), Dimension("c", False, 0)], ["c", "a", "b"], bits=3, rows_per_file=11)
    rows = [(i, r.randrange(100), r.choice("xyz"), r.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, a long, b string, c long")
    assert by_position(of(zorder_layout.place(df, layout))) == by_position(brute(rows, layout))
    for wrong in (dict(interleaved=["a", "b"]), dict(dimensions=[Dimension("a", False, 1)], interleaved=["a"]), dict(bits=9)):
        with pytest.raises(ValueError):
            Layout(**{"dimensions": layout.dimensions, "interleaved": layout.interleaved, **wrong})


def test_layout_of_nothing(spark):
    assert of(zorder_layout.place(zorder_layout.document_values(docs_of(spark, [])), DOCUMENTS)) == []
    assert of(zorder_layout.place(zorder_layout.document_values(docs_of(spark, [(1, None, None, None)])), DOCUMENTS)) == [(1, 0, 0, 0, 1, 1, "0,0,0,0,0,0,0,0")]


def test_written_files_are_clustered_and_pruned(spark, tmp_path):
    rows = made(300)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    layout = Layout(DOCUMENTS.dimensions, DOCUMENTS.interleaved, rows_per_file=20)
    manifest = zorder_layout.write_layout(docs, str(tmp_path / "files"), layout)
    want = brute(values(rows), layout)
    assert {(r["file"], r["n_rows"], r["file_bounds"]) for r in manifest.collect()} == {(f, sum(w[3] == f for w in want), next(w[6] for w in want if w[3] == f)) for f in {w[3] for w in want}}
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "files")).select("doc_id", "file").collect()) == sorted((w[0], w[3]) for w in want)
    box = {"source": (0, 3), "length": (10, 15)}
    inside = {f for f, b in {(w[3], w[6]) for w in want} if (e := [int(x) for x in b.split(",")]) and e[0] <= 3 and e[1] >= 0 and e[4] <= 15 and e[5] >= 10}
    got = zorder_layout.read_files(spark, str(tmp_path / "files"), manifest, box, layout)
    assert {r["file"] for r in got.select("file").distinct().collect()} == inside and len(inside) < len({w[3] for w in want})


def test_op13_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op13_zorder_layout(spark, sf)
    want = con.sql(queries.ORACLE_SQL["op13_zorder_layout"])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    rows = con.sql("SELECT doc_id, source, lang, text FROM documents").fetchall()
    assert by_position(of(got)) == by_position(brute(values(rows), DOCUMENTS))
