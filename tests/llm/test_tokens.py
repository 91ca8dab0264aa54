import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from weftgraph.llm import byte_bpe, packing, queries, shared, token_files
from weftgraph.llm.wordcache import CachedTokenizer

EDGES = [
    (0, "a b"), (1, ""), (2, None), (3, "  x \n\n y "), (4, "don't 's's 'tis !'s I'LL 5's"), (4, "same id"), (None, "no id"), (5, "a" * 5000),
    (6, "é ́x　y"), (7, "# #"), (8, "<|endoftext|>"), (9, "word " * 6000), (10, "same id"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, start string, ids int")


def fuzz(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("abtsrelvdm ''\n\t.1é　!ΣǅⅣ٣") for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_tokenizer_equals_library(name, keeps):
    whole = Tokenizer.from_file(P.path(name))
    cached = CachedTokenizer(P.path(name), keeps, entries=50)
    texts = [*fuzz(800), *(t or "" for _, t in EDGES), "a page about <|endoftext|> markers", "<|startoftext|>x y<|endoftext|>\n", "<|ENDOFTEXT|> z"]
    want = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    many = cached.encode_many(pa.array(texts))
    for text, ids, got in zip(texts, want, many):
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == ids, repr(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(text)
    assert cached.encode_many(pa.array([], pa.string())) == []
    assert cached.encode_many(pa.array(["x", *texts]).slice(1)) == many


def truth1(rows):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark):
    folder = shared.new_path(spark, "test-tokens")
    manifest = token_files.write_token_files(docs_of(spark, EDGES), folder, P.path("byte_bpe_50k.json"), 2, length=16, rows_per_batch=4)
    got = [tuple(r) for r in token_files.read_token_files(spark, manifest).collect()]
    key = lambda r: (r[1],)
    assert sorted(got, key=key) == truth1(EDGES)
    m = manifest.orderBy("shard").first()
    fs, root = pafs.FileSystem.from_uri(m["path"])
    reader = token_files.ShardReader(fs, root)
    ids, mask = reader.sequence(0)
    assert len(ids) == 16 and not ids.flags.owndata and len(mask) == 16
    rows = [x for r in manifest.collect() for x in [r["n_tokens"]]]
    assert sum(rows) == sum(r[2] for r in truth1(EDGES))


def test_token_files_empty_table(spark):
    empty = docs_of(spark, EDGES).limit(0)
    m = token_files.write_token_files(empty, shared.new_path(spark, "t"), P.path("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(spark, m).count() == 0


def test_op1_on_documents(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted(tuple(r) for r in queries.op1_token_files(spark, sf).collect())
    assert got == truth1(list(zip(t["doc_id"], t["text"])))


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken():
    enc, own = tik(), byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    texts = fuzz(4000) + ["a" + chr(c) + "b" for c in range(0x3100)] + ["ab" * 3000, "x" * 999, "'s" * 50]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text), repr(text)


def test_byte_bpe_edges(spark):
    ranks = P.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs_of(spark, EDGES), ranks), ranks, with_offsets=True).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in out) == sorted(t or "" for _, t in EDGES)
    for r in out:
        assert len(r["offsets"]) == r["n_tokens"] == len(r["ids"]) // 4
    assert byte_bpe.encode_documents(docs_of(spark, EDGES).limit(0), ranks).count() == 0


def test_op10_on_documents(spark, sf):
    enc = tik()
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = set()
    for d, x in zip(t["doc_id"], t["text"]):
        ids = enc.encode_ordinary(x)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op10_byte_bpe(spark, sf).collect()} == want


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(b) <= capacity.vector()[1] and sum(n * n for _, n in b) <= capacity.vector()[2]
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(64), packing.Capacity(64, documents=3), packing.Capacity(64, attention=1500)])
def test_packing_plan(spark, rule, capacity):
    r = random.Random(5)
    top = 38 if capacity.attention else 64
    rows = [(i, 0, 7 if i % 3 == 0 else r.randint(1, top)) for i in range(900)]
    pieces = spark.createDataFrame(rows, "row long, piece int, length long")
    n = check_packing(packing.assign(pieces, capacity, rule, salt=4).collect(), capacity)
    need = np.array([[x, 1, x * x] for _, _, x in rows]).sum(0) / capacity.vector()
    assert n <= 1.25 * need.max() + 1


def test_packing_weighs_all_capacities():
    """The best fit depends on documents and attention, not on tokens alone."""
    counts = {40: 3, 30: 5, 17: 9, 9: 20, 3: 30}
    three, one = (packing.plan(counts, packing.Capacity(64, documents=6, attention=2200), rule="norm", weights=w) for w in ((1.0, 1.0, 1.0), (1.0, 0.0, 0.0)))
    assert any(three[k].tolist() != one[k].tolist() for k in counts)


def test_packing_spreads_a_length_that_most_pieces_share(spark):
    rows = [(i, 0, 64 if i % 3 else 1 + i % 50) for i in range(3000)]
    out = packing.assign(spark.createDataFrame(rows, "row long, piece int, length long"), packing.Capacity(64)).collect()
    check_packing(out, packing.Capacity(64))
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(rows)


def test_packing_edges(spark):
    out = packing.pack_documents(docs_of(spark, EDGES), P.path("word_bpe_49k.json")).collect()
    check_packing(out, packing.Capacity())
    assert len({r["row"] for r in out}) == len(EDGES)
    assert max(r["piece"] for r in out) > 0 and all(r["length"] == 2048 or r["doc_id"] != 9 or r["piece"] == 2 for r in out)
    assert packing.pack_documents(docs_of(spark, EDGES).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_op9_on_documents(spark, sf):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want, total = set(), 0
    for d, x in zip(t["doc_id"], t["text"]):
        ids = np.array([*tok.encode(x, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want.add((d, p // 2048, p, len(part), zlib.crc32(part.tobytes())))
    out = queries.op9_best_fit_packing(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    assert check_packing(out, packing.Capacity()) <= total / 2048 * 1.02 + 2
