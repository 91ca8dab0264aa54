"""Document fingerprints that subtract: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and the sentences of a line).  Each paragraph, with the number of its
occurrence in the text, gives a 64-bit digest; the digest is added to one cell in each third of the sketch.  A cell
holds a count, the XOR of its digests and the XOR of their checks.  The difference of two sketches holds only
what the texts don't share; cells with one digest are peeled until none is left, which recovers the differing digests.

The fingerprint of a text is its sketch with ``CELLS`` cells and its number of paragraphs: a function of the text
alone, so equal texts have equal fingerprints.  The likeness of two texts comes from the difference of their fingerprints.  Where peeling it fails, the
squares of its counts, of which every differing digest adds about one to each third, tell how many digests differ; both sketches are
built anew for so many, at least twice as large, until one is peeled.  Null text counts as empty (no paragraphs; two empty texts are
alike to 1).  An empty table gives no rows.  Rows are ordered by doc_id (null first), ties by a hash of the
text and the text; repeated rows follow each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Cells of a fingerprint; a multiple of three.
CELLS = 24
_PARAGRAPH = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
_MASK = (1 << 64) - 1
_CELL = np.dtype([("count", "<i2"), ("digest", "<u8"), ("check", "<u4")])


def digests(text: str) -> np.ndarray:
    """A digest for each paragraph; the k-th repetition of a paragraph has its own."""
    seen: Counter = Counter()
    out = []
    for p in _PARAGRAPH.findall(text):
        if p := p.strip():
            out.append((xxhash.xxh3_64_intdigest(p), seen[p]))
            seen[p] += 1
    pairs = np.array(out, dtype=np.uint64).reshape(-1, 2)
    return np.unique(_mix(pairs[:, 0] + pairs[:, 1] * np.uint64(0xD6E8FEB86659FD93), 5))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_SHIFTS = (0, 21, 42)  # a digest's bits give its cell in each third
_CHECK = 0x9E3779B97F4A7C15


def sketch(d: np.ndarray, cells: int = CELLS) -> np.ndarray:
    out = np.zeros(cells, _CELL)
    if len(d):
        third = np.uint64(cells // 3)
        at = np.concatenate([((d >> np.uint64(s)) % third) + third * np.uint64(k) for k, s in enumerate(_SHIFTS)]).astype(np.int64)
        out["count"] = np.bincount(at, minlength=cells)
        check = (d * np.uint64(_CHECK)) >> np.uint64(32)
        np.bitwise_xor.at(out["digest"], at, np.concatenate([d, d, d]))
        np.bitwise_xor.at(out["check"], at, np.concatenate([check, check, check]).astype(np.uint32))
    return out


def peel(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]] | None:
    """Digests only in a's text and only in b's, from the sketches; None if some can't be recovered."""
    count = (a["count"].astype(np.int64) - b["count"]).tolist()
    digest, check = (a["digest"] ^ b["digest"]).tolist(), (a["check"] ^ b["check"]).tolist()
    third, only, left = len(count) // 3, ([], []), 4 * len(count)
    todo = [i for i, c in enumerate(count) if c == 1 or c == -1]
    while todo and left:
        i = todo.pop()
        sign, value = count[i], digest[i]
        if (sign != 1 and sign != -1) or (value * _CHECK & _MASK) >> 32 != check[i]:
            continue
        cells = (value % third, (value >> 21) % third + third, (value >> 42) % third + 2 * third)
        if i not in cells:
            continue
        c, left = check[i], left - 1
        only[sign < 0].append(value)
        for k in cells:
            count[k] -= sign
            digest[k] ^= value
            check[k] ^= c
            if count[k] == 1 or count[k] == -1:
                todo.append(k)
    return None if any(count) or any(digest) or any(check) else only


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """How many digests two sketches differ in, about: without bias, as digests fall into cells at random."""
    count = a["count"].astype(np.float64) - b["count"]
    return float((count**2).sum() / 3)


def differing(a: np.ndarray, b: np.ndarray, cells: int = CELLS, sketches: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[int], list[int]]:
    """The digests in which two texts differ, from the difference of their sketches with ``cells`` cells (given, or built), then of larger ones; a
    retry with enough cells for the estimated difference fails with a small probability only."""
    x, y = sketches if sketches is not None else (sketch(a, cells), sketch(b, cells))
    while (only := peel(x, y)) is None:
        cells = 3 * -(-max(2 * cells, int(1.7 * min(estimate(x, y), len(a) + len(b)))) // 3)
        x, y = sketch(a, cells), sketch(b, cells)
    return only


def fingerprint(d: np.ndarray, s: np.ndarray | None = None) -> str:
    return f"{len(d)}:{(sketch(d) if s is None else s).tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray, sketches: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Shared paragraphs among all paragraphs of both, from the difference that their fingerprints' sketches give."""
    n = len(a) + len(b)
    if not n:
        return 1.0
    d = sum(map(len, differing(a, b, sketches=sketches)))
    return (n - d) / (n + d)


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie below a value: counted among blocks of cuts first, then within one, so the work grows with the root of their number."""
    if not cuts:
        return F.lit(0)
    size = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    # The block before the first one that begins at or above the value holds the place.
    block = F.greatest(below(F.array(*[F.lit(b[0]) for b in blocks])) - 1, F.lit(0))
    table = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    return block * size + below(F.get(table, block))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ghost, doc_id, h, text) dealt out so that each bucket, in order, is followed by its next row as a ghost.

    Buckets are ranges of doc_id.  The driver holds two scalars for each bucket (its first row's doc_id and hash),
    never texts; the first row of each bucket is sent to the bucket before it as well.
    """
    spark = docs.sparkSession
    rows = shared.texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64("text").alias("h"), "text")
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = shared.texts(docs).select(F.approx_percentile("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("bucket", _bucket(F.col("o"), cuts))
    firsts = sorted((r["bucket"], r["f"]["o"], r["f"]["h"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("o", "h")).alias("f")).collect())
    if not firsts:
        return rows.withColumn("ghost", F.lit(False))
    before = [(b, o, h, firsts[i - 1][0]) for i, (b, o, h) in enumerate(firsts)]
    # Narrow table of one row a bucket.
    heads = spark.createDataFrame(before, "bucket int, fo long, fh long, prev int")
    rows = rows.join(F.broadcast(heads), "bucket")
    ghost = (F.col("o") == F.col("fo")) & (F.col("h") == F.col("fh"))
    to = F.when(ghost, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("prev").alias("b"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g"))))
    rows = rows.withColumn("_to", F.explode(to)).select(F.col("_to.b").alias("bucket"), F.col("_to.g").alias("ghost"), "doc_id", "o", "h", "text")
    return rows.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "ghost", "o", "h", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_chars, fingerprint; next_doc_id, next_fingerprint and near_next for the row after it
    (after the last: the first); edited (text), edited_fingerprint and near_edited for its edited text, whose last
    floor(n_chars / 2) code points are replaced by as many of the next text's first (or all)."""
    schema = "doc_id long, n_chars long, fingerprint string, next_doc_id long, near_next double, edited_sha256 string, edited_fingerprint string, near_edited double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # the row that waits for its next one: bucket, doc_id, text, digests
        for batch in shared.slices(batches):
            columns = (batch.column(k).to_pylist() for k in ("bucket", "ghost", "doc_id", "text"))
            for bucket, ghost, doc_id, text in zip(*columns):
                if held and ghost and held[0] != bucket:
                    continue
                if not held and ghost:
                    continue
                d = digests(text)
                s = sketch(d)
                if held:
                    out.append(_row(held, doc_id, text, d, s))
                held = None if ghost else (bucket, doc_id, text, d, s)
                if len(out) >= 2000:
                    yield _record(out)
                    out = []
        if out:
            yield _record(out)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]
    _record = lambda out: pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=names)
    return with_next(docs).mapInArrow(work, schema)


def _row(held: tuple, next_id: int | None, next_text: str, next_d: np.ndarray, next_s: np.ndarray) -> tuple:
    _, doc_id, text, d, s = held
    n = len(text)
    edited = text[: n - n // 2] + next_text[: n // 2]
    e = digests(edited)
    t = sketch(e)
    return doc_id, n, fingerprint(d, s), next_id, likeness(d, next_d, (s, next_s)), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(e, t), likeness(d, e, (s, t))
