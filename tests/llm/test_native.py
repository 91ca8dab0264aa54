import hashlib
import math
import random
import re
from collections import Counter

import pytest

from weftgraph.llm import licenses, pii, queries

#: The plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def row(d, t):
    b = base(t)
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
    return d, *[sum(x[0] == k for x in b) for k in PLAIN], hashlib.sha256(listed.encode()).hexdigest(), listed


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, spans string, license int")


def fuzz():
    r = random.Random(1)
    parts = ["a", "b.c", "@", "1", "2.", "255", "256", "+", "4", "-", " ", ".", "(", "𝒳", "é", "4111 1111 1111 1111", "x@y.zz", "1.2.3.4", "+1 (555) 123-4567", "0255.1.1.1"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(30)))) for i in range(1500)]
    return rows + [(5000, None), (5001, ""), (5002, "a" * 50000), (5003, "1" * 30000), (5004, "a." * 20000 + "@" + "b." * 10000 + "c"), (5006, "a@b.co_x@y.zz"), (5007, "+1" + "(" * 20000)]


def test_base_spans_equal_plain_patterns(spark):
    rows = fuzz()
    got = sorted((*tuple(r)[:5], r["base_sha256"], r["spans"]) for r in pii.pii_spans(docs_of(spark, rows)).collect())
    assert got == sorted(row(*r) for r in rows)


def test_disclosing_terms_and_masks(spark):
    names = ["quorvath", "zelmindra", "obriskan"]
    rows = [(i, f"{names[i % 3]} number{chr(97 + i)}x writes from u{i % 3}@mail.org about common things ({i})") for i in range(12)]
    rows += [(100 + i, f"common things and other words variant{chr(97 + i)} here") for i in range(26)]
    rows += [(200 + i, rows[12][1]) for i in range(30)] + [(300, None), (None, "u0@mail.org quorvath, Quorvath!")]
    out = {(r["doc_id"], r["spans"]) for r in pii.pii_spans(docs_of(spark, rows)).collect()}
    by_id = dict(x for x in out if x[0] is not None)
    assert all(by_id[i].split(",")[-1] == f"term:0:{len(names[i % 3])}" for i in range(12))
    assert dict(out)[None].count("term:") == 2 and by_id[300] == "" and by_id[100] == ""
    clean = {r["doc_id"]: r for r in pii.sanitize(docs_of(spark, rows)).collect()}
    assert clean[0]["text"].startswith("[TERM] numberax writes from [EMAIL] about") and clean[0]["spans"] == "clash"
    assert clean[None]["text"] == "[EMAIL] [TERM], [TERM]!" and clean[300]["text"] is None and clean[100]["text"] == dict(rows)[100]
    assert pii.pii_spans(docs_of(spark, rows).limit(0)).count() == 0


def test_terms_of_entities_in_one_text(spark):
    many = [(1000 + i, f"plain filler words number {i}") for i in range(3000)]
    rows = [(1, "write to solo@mail.org about Quorvath and filler"), (2, "zelmindra waits"), (3, "call duo@mail.org for zelmindra")]
    out = {r["doc_id"]: r for r in pii.pii_spans(docs_of(spark, rows + many)).where("doc_id < 10").collect()}
    words = lambda i: [dict(rows)[i][int(s):int(e)] for k, s, e in (x.split(":") for x in out[i]["spans"].split(",") if x) if k == "term"]
    assert words(1) == ["write", "about", "Quorvath"] and words(2) == [] and words(3) == ["call"]
    few = {r["doc_id"]: r["n_term"] for r in pii.pii_spans(docs_of(spark, rows + many[:100])).collect()}
    assert set(few.values()) == {0}


def test_copies_are_no_evidence(spark):
    rows = [(i, f"quorvath has written from u@mail.org in case {chr(97 + i) * 4}") for i in range(3)]
    rows += [(100 + i, rows[0][1]) for i in range(300)] + [(1000 + i, f"plain filler number {i}") for i in range(700)]
    out = {r["doc_id"]: r["spans"] for r in pii.pii_spans(docs_of(spark, rows)).where("doc_id < 1000").collect()}
    assert len(out) == 303 and all("term:0:8" in s.split(",") for s in out.values())


def brute_terms(texts, support=3, disclosure=0.8):
    """Terms of each distinct text by plain counts."""
    terms = lambda t: {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 4}
    held, n_t, n_e, n_et = {}, Counter(), Counter(), Counter()
    for t in texts:
        n_t.update(terms(t))
        if spans := base(t):
            bare = t
            for _, a, b in spans:
                bare = bare.replace(t[a:b], " ")
            held[t] = {(k, t[a:b]) for k, a, b in spans}, terms(bare)
            n_e.update(held[t][0])
            n_et.update((e, w) for e in held[t][0] for w in held[t][1])

    def discloses(e, w):
        k, n, z = n_et[e, w], max(n_t[w], n_et[e, w]), 1.96**2
        low = (k / n + z / 2 / n - math.sqrt(z * (k / n * (1 - k / n) / n + z / 4 / n / n))) / (1 + z / n)
        information = math.log2(len(texts) / n_e[e])
        return information > 0 and math.log2(k / n if k >= support else low) + information >= information * disclosure

    return {t: {w for w in ws if any(discloses(e, w) for e in es)} for t, (es, ws) in held.items()}


def test_terms_appear_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = brute_terms(set(text.values()))
    out = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",")] for r in queries.op3_pii(spark, sf).where("n_term > 0").collect()}
    got = {d: {text[d][int(a) : int(b)].lower() for k, a, b in spans if k == "term"} for d, spans in out.items()}
    print("documents with terms", len(got), "spans", sum(k == "term" for s in out.values() for k, _, _ in s), "terms", len(set().union(*got.values())))
    assert got and got == {d: want[t] for d, t in text.items() if want.get(t)}


def test_op3_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((*tuple(r)[:5], r["base_sha256"]) for r in queries.op3_pii(spark, sf).collect())
    assert got == sorted(row(*r)[:6] for r in rows)


def brute_licenses(rows, templates, least=0.75):
    out = {}
    for d, t in rows:
        words = re.findall("[a-z0-9]+", (t or "").lower())
        for m, _, own in licenses.size_classes(templates, least, 1e-4):
            for at in range(0, len(words), m):
                window = words[at : at + 2 * m]
                have = {tuple(window[i : i + 5]) for i in range(len(window) - 4)}
                for name, w in own:
                    need = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
                    share = len(have & need) / len(need)
                    if share >= least:
                        best, n, first = out.get((d, name), (0, 0, at))
                        out[d, name] = (max(best, share), n + 1, min(first, at))
    return sorted((d, name, round(b, 6), n, f) for (d, name), (b, n, f) in out.items())


def test_license_scan_equals_brute_force(spark):
    r = random.Random(4)
    texts = list(licenses.TEMPLATES.values())
    rows = []
    for i in range(200):
        words = [f"w{r.randrange(500)}" for _ in range(r.randrange(0, 120))]
        if i % 2:
            t = r.choice(texts).split()
            if r.random() < 0.5 and len(t) > 12:
                t[r.randrange(len(t))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = t
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "license"), (903, " ".join(texts))]
    got = sorted(tuple(x) for x in licenses.scan(docs_of(spark, rows)).collect())
    assert got == brute_licenses(rows, licenses.TEMPLATES)
    assert licenses.scan(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shortest, most", [(5, 8), (9, 16), (17, 32)])
def test_band_settings(shortest, most):
    b = licenses.bands_for(shortest, most, 0.75, 1e-4)
    s = shortest - 4
    need = -(-3 * s // 4)
    assert (1 - need / (2 * most - 4 + s - need)) ** b <= 1e-4


def test_op6_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(x) for x in queries.op6_license_scan(spark, sf).collect()) == brute_licenses(rows, licenses.TEMPLATES)


def test_short_notices_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {d for d, t in text.items() if " all rights reserved " in f" {' '.join(re.findall('[a-z0-9]+', t.lower()))} "}
    got = queries.op6_short_notices(spark, sf).collect()
    assert len(want) >= 66 and {r["doc_id"] for r in got} == want
    assert {(r["license"], r["containment"]) for r in got} == {("All-rights-reserved-line", 1.0)}


def test_short_and_long_templates_together(spark):
    filler = " ".join(f"w{i}" for i in range(37))
    rows = [(1, "(c) ALL rights\nreserved."), (2, f"{filler} all rights reserved {filler}"), (3, "all rights are reserved"), (4, f"x {licenses.TEMPLATES['MIT']} {filler}"), (5, "public"), (6, None)]
    got = {(r["doc_id"], r["license"], r["n_windows"], r["first_word"]) for r in licenses.scan(docs_of(spark, rows), {**licenses.TEMPLATES, **licenses.SHORT_TEMPLATES, "one": "Public"}).collect()}
    assert got == {(1, "All-rights-reserved-line", 1, 0), (2, "All-rights-reserved-line", 2, 24), (4, "MIT", 1, 0), (5, "one", 1, 0)}


def test_sanitize_with_clashing_columns(spark):
    names = ["doc_id", "text", "_text", "_h", "_base", "_spans", "_pattern", "d"]
    docs = spark.createDataFrame([(1, "mail bob@example.com now", "own", "h", "b", "s", "p", "x"), (2, None, "own", "h", "b", "s", "p", "x")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = sorted((tuple(r) for r in pii.sanitize(docs).collect()), key=lambda r: r[0])
    assert got == [(1, "mail [EMAIL] now", "own", "h", "b", "s", "p", "x"), (2, None, "own", "h", "b", "s", "p", "x")]


def test_scan_without_templates(spark):
    assert licenses.scan(docs_of(spark, [(1, "licensed under the MIT license")]), {}).count() == 0
