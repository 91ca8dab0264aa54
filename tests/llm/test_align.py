import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from weftgraph.llm import cross_align, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokenizers():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, SentencePieceProcessor(model_file=B)


def brute(tok, sp, alphabet, text):
    """n_a, n_b, group strings, linked pairs, cuts."""
    nothing = (0, 0, [], [], [])
    if not text:
        return nothing
    a, b, want = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
    bytes_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return nothing
    ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
    groups, links, i, j, cuts = [], [], 0, 0, sorted(set(ends_a) & set(ends_b))
    for cut in cuts:
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        links += [(x, y) for x, p in zip(a[i:k], ends_a[i:k]) for y, q in zip(b[j:m], ends_b[j:m]) if p == q]
        i, j = k, m
    return len(a), len(b), groups, links, cuts


def want_rows(rows):
    tok, sp = tokenizers()
    alphabet = cross_align.byte_level_alphabet()
    each = [(d, *brute(tok, sp, alphabet, t)) for d, t in rows]
    n = Counter(x for r in each for x in r[4])
    best = Counter()
    for (_, y), k in n.items():
        best[y] = max(best[y], k)
    return sorted(
        ((d if d is not None else -9, a, b, len(g), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, links, _ in each)
    )


def fuzz(n=400):
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "<|endoftext|>", "<s>", "</s>", "▁", "'s", "'re", "12", "...", "\x00", "\x1c", "\x85", "​", "　", "😀", "Hello", "world", "<0x41>", "ﬁ", "é", "�"]
    made = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))) for i in range(n)]
    return made + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "ab " * 30_000), (n + 4, "x" * 5_000), (7, "a repeated id"), (None, "no id"), (None, "no id"), (n + 5, "▁ " * 100)]


def run(spark, rows, top=65_536):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, groups string, pairs int")
    aligned = cross_align.align_documents(docs, A, B).withColumnRenamed("groups", "g").drop("cuts")
    out = cross_align.score_links(aligned, top).collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -9, r["n_a"], r["n_b"], r["n_groups"], r["n_groups"], r["n_best"], r["count_sum"], hashlib.sha256(r["g"].encode()).hexdigest() if r["n_a"] else "") for r in out)


@pytest.mark.parametrize("top", [65_536, 20])
def test_alignment_equals_brute_force(spark, top):
    rows = fuzz()
    assert run(spark, rows, top) == want_rows(rows)


def test_alignment_of_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_are_byte_offsets(spark):
    rows = [r for r in fuzz(150) if r[0] is not None]
    tok, sp = tokenizers()
    alphabet = cross_align.byte_level_alphabet()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_a"], list(r["cuts"])) for r in cross_align.align_documents(docs, A, B, with_cuts=True).collect())
    want = [(d, *brute(tok, sp, alphabet, t)) for d, t in rows]
    assert got == sorted((w[0], w[1], w[5]) for w in want)


def test_ranks_count_bits():
    r = np.random.default_rng(1)
    ends_a, ends_b = (np.flatnonzero(r.random(1000) < 0.3) + 1 for _ in range(2))
    cuts, upto_a, upto_b = cross_align.shared_cuts(ends_a, ends_b, 1000)
    assert cuts.tolist() == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert upto_a.tolist() == [(ends_a <= c).sum() for c in cuts] and upto_b.tolist() == [(ends_b <= c).sum() for c in cuts]


def test_a_worker_that_remembers_nothing_gives_the_same():
    import pyarrow as pa

    a, b = cross_align.byte_level(A), cross_align.pieces(B)
    texts = pa.array([t for _, t in fuzz(200) if t is not None])
    assert cross_align.Aligner(a, b, entries=0).texts(texts) == cross_align.Aligner(a, b).texts(texts)


def test_op11_on_documents(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted(tuple(r) for r in queries.op11_cross_align(spark, sf).collect())
    assert got == want_rows(list(zip(t["doc_id"], t["text"])))
