"""Vector best-fit packing of token pieces into sequences.

A bin has capacities for tokens, documents and attention cost (the sum of squared lengths); a piece of length
n takes (n, 1, n * n) of them.  Pieces are taken by falling length; each goes to the open bin, among those that
hold it under every constraint, with the largest weighted dot product of need and residual, or with the smallest
weighted norm of what remains ("norm", the default).  Pieces of one length are alike, and so are bins with the
same residual, so bins are kept as *groups* (a residual and a number of bins) and whole groups are filled at once:
the plan depends on the histogram of lengths alone, which has at most ``capacity`` entries however large the corpus.
Its size is bounded by the capacity too (a piece length splits at most one group per residual), so every
executor can hold it, while pieces find their places by their number among the pieces of their length.

Null text counts as empty (its end id is still packed); an empty table packs into nothing; repeated rows and
ids are packed once for each row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .wordcache import cached_tokenizer


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int | None = None  # none: as many as there are tokens
    attention: int | None = None  # none: a sequence of one piece

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


@dataclass
class _Group:
    left: np.ndarray  # residual capacities
    used: int  # tokens placed in each
    first: int  # the first bin's number; the group's bins are numbered on from it
    n: int


def plan(histogram: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> dict[int, np.ndarray]:
    """For each length, rows (first piece, pieces in each bin, first bin, offset in it): piece i of the length lies in
    the row with the last ``first piece`` <= i, in bin ``first bin + (i - first) // each``, behind ``(i - first) % each`` others."""
    full = capacity.vector()
    scale = np.asarray(weights, dtype=float) / full.astype(float) ** 2
    groups: list[_Group] = []
    out: dict[int, list[tuple]] = {}
    bins = 0

    def place(g: _Group, need: np.ndarray, length: int, done: int, todo: int) -> tuple[list[_Group], int]:
        """Fills bins of ``g`` one after the other; the groups it becomes and the pieces placed."""
        each = int(min(g.left // need))
        whole = min(g.n, todo // each)
        parts, placed, first = [], whole * each, g.first
        if whole:
            out.setdefault(length, []).append((done, each, first, g.used))
            parts.append(_Group(g.left - each * need, g.used + each * length, first, whole))
            first += whole
        rest = todo - placed
        if rest and whole < g.n:
            out.setdefault(length, []).append((done + placed, rest, first, g.used))
            parts.append(_Group(g.left - rest * need, g.used + rest * length, first, 1))
            placed, first = placed + rest, first + 1
        if first < g.first + g.n:
            parts.append(_Group(g.left, g.used, first, g.first + g.n - first))
        return parts, placed

    for length in sorted(histogram, reverse=True):
        todo, done = histogram[length], 0
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        while todo:
            left = np.array([g.left for g in groups]).reshape(-1, 3)
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                rest = left[fits] - (need if rule == "norm" else 0)
                score = ((rest.astype(float) ** 2) * scale).sum(1) if rule == "norm" else -(rest * need * scale).sum(1)
                k = int(fits[np.argmin(score)])
                parts, placed = place(groups.pop(k), need, length, done, todo)
            else:
                each = int(min(full // need))
                n = -(-todo // each)
                parts, placed = place(_Group(full, 0, bins, n), need, length, done, todo)
                bins += n
            groups += [g for g in parts if g.left[0] and g.left[1]]
            done, todo = done + placed, todo - placed
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int = 2048) -> DataFrame:
    """doc_id, row, piece, start, length, ids (little-endian unsigned 32-bit) of each document's ids and end id,
    cut into runs of ``most`` only where a document is longer.  ``row`` tells equal doc_ids apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = cached_tokenizer(tokenizer, False, "<u4"), np.array([end_id], "<u4").tobytes()
        for batch in shared.slices(batches, most=8 << 20, owner="words"):
            out: list[tuple] = []
            for doc_id, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), tok.encode_many(batch.column("text"))):
                ids += end
                out += [(doc_id, row, p, p * most, len(part) // 4, part) for p in range(-(-len(ids) // (4 * most))) for part in [ids[4 * most * p : 4 * most * (p + 1)]]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=["doc_id", "row", "piece", "start", "length", "ids"])

    rows = shared.texts(docs).withColumn("row", F.monotonically_increasing_id())
    return shared.table(rows.mapInArrow(cut, "doc_id long, row long, piece int, start long, length long, ids binary"), "pieces")


def assign(pieces: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple = (1.0, 1.0, 1.0), salt: int = 4) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (columns row, piece and length are needed; others are kept).

    Pieces are numbered within (length, salt).  A length gets salts by its share of all pieces, ``salt`` times as many as there are shuffle partitions in all and one at
    least, so a length that a third of all pieces share is spread over tasks; the salts' counts, at most the lengths and these salts, give the numbers where each salt begins.
    """
    spark = pieces.sparkSession
    # One row for each length that occurs: at most ``capacity.tokens``.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows, total = plan(histogram, capacity, rule, weights), max(1, sum(histogram.values()))
    parts = salt * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = spark.createDataFrame([(k, -(-n * parts // total)) for k, n in histogram.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(share), "length").withColumn("_salt", F.expr("pmod(xxhash64(row, piece), _salts)").cast("int"))
    counts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = shared.table(counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))), "lengths")

    numbered = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("row", "piece")) - 1)
    numbered = numbered.join(F.broadcast(counts.select("length", "_salt", "_before")), ["length", "_salt"]).withColumn("_i", F.col("_n") + F.col("_before"))
    names = pieces.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, index = (batch.column(k).to_numpy() for k in ("length", "_i"))
            bins, offset = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            order = np.argsort(lengths, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(lengths[order])) + 1, len(order))
            for a, b in zip(np.append(0, ends[:-1]), ends):
                own = order[a:b]
                if len(own):
                    table, i = rows[int(lengths[own[0]])], index[own]
                    first, each, to, used = table[np.searchsorted(table[:, 0], i, side="right") - 1].T
                    bins[own], offset[own] = to + (i - first) // each, used + (i - first) % each * lengths[own]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.select(*names, "_i").mapInArrow(find, kinds + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: Capacity = Capacity(), rule: str = "norm") -> DataFrame:
    """Every piece of every document with its ids, its sequence and its place there."""
    return assign(tokenize_pieces(docs, tokenizer, end_id, capacity.tokens), capacity, rule)
