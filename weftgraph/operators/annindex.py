"""Approximate nearest neighbours: two-level lists whose number grows with the vectors, residual codes, exact re-ranking.

A vector belongs to the nearest coarse centre and, within it, to the nearest of that centre's own lists; their number is about ``sqrt`` of the vectors, up to a
fixed bound, so that what is broadcast has one too.  What is left of a vector after its list's centre is cut into sub-vectors and each is replaced by the
nearest of a codebook: one byte each.  A query reads the lists nearest to it, scores their codes by tables of inner products, and its best ``k * refine``
are compared exactly.  Lists are cut into slices, and queries into blocks, so neither a list that holds most vectors nor many queries make one large task.

Centres and codebooks are fitted on a bounded sample (``sample`` vectors with the smallest hashes); every vector is coded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import work_table

#: Bounds of what is fitted and broadcast: vectors of the sample, lists, and codewords of a sub-vector.
SAMPLE, MOST_LISTS, CODEWORDS = 20_000, 65_536, 256
#: The most that codes may lose of what is left of the sample's vectors after their lists' centres, as a share of its squares.
LOSS = 0.02
#: Vectors of a slice of a list, and queries of a block.
SLICE, BLOCK = 20_000, 2_048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def kmeans(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7, unit: bool = True) -> np.ndarray:
    """At most ``n`` centres; each start is drawn with the square of its distance to those before."""
    r, n = np.random.default_rng(seed), min(n, len(x))
    c, far = [x[r.integers(len(x))]], np.full(len(x), np.inf)
    for _ in range(n - 1):
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
        c.append(x[r.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[r.integers(len(x))])
    c = np.stack(c)
    for _ in range(rounds):
        near = _nearest(x, c)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(n)])
        c = _unit(c) if unit else c
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c**2).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclass
class Model:
    """Unit centres of all lists, and the codebooks (sub-vectors x codewords x length)."""

    centres: np.ndarray
    books: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centres)
        rest = (x - self.centres[own]).reshape(len(x), len(self.books), -1)
        return own, np.stack([_nearest(rest[:, j], b) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's sub-vectors with all codewords."""
        return np.einsum("qjd,jcd->qjc", q.reshape(len(q), len(self.books), -1), self.books)

    def halves(self, own: int, code: np.ndarray) -> np.ndarray:
        """Half the squared length of what the codes of one list stand for.  Less by it, inner products rank as distances do: the part of a code's error that lies along its centre, which is
        large beside the differences within a narrow list, then cancels."""
        c = self.centres[own]
        table = self.tables(c[None])[0] + 0.5 * (self.books**2).sum(2)
        return 0.5 * (c**2).sum() + sum(table[j, code[:, j]] for j in range(code.shape[1]))


def n_lists(n: int) -> int:
    """Lists of an index of ``n`` vectors."""
    return int(min(MOST_LISTS, max(1, round(n**0.5))))


def fit(vectors: DataFrame, parts: int = 8, sample: int = SAMPLE) -> Model:
    """Lists and codebooks for ``vectors`` (vec_id, embedding of one length that ``parts`` divides), which must hold some.

    ``parts`` is the least number of sub-vectors: it is doubled until the codes lose at most ``LOSS``, or no length is left to halve.  A fixed number loses neighbours as vectors become more, since
    the scores of the first few hundred then lie nearer to each other than the codes can tell."""
    lists = n_lists(vectors.count())
    rows = vectors.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).collect()  # at most ``sample`` vectors
    x = _unit(np.array([r["embedding"] for r in rows], dtype=float))
    if x.shape[1] % parts:
        raise ValueError(f"{parts} sub-vectors do not divide {x.shape[1]} places")
    coarse = kmeans(x, max(1, round(lists**0.5)))
    near = _nearest(x, coarse)
    share = np.bincount(near, minlength=len(coarse)) / len(x)
    centres = np.concatenate([kmeans(x[near == i], max(1, round(lists * share[i])), seed=i) for i in range(len(coarse)) if (near == i).any()])
    rest, words = x - centres[_nearest(x, centres)], min(CODEWORDS, len(x))
    while True:
        cut = rest.reshape(len(x), parts, -1)
        books = [kmeans(cut[:, j], words, 4, j, unit=False) for j in range(parts)]
        lost = sum(((cut[:, j] - b[_nearest(cut[:, j], b)]) ** 2).sum() for j, b in enumerate(books))
        if lost <= LOSS * (rest**2).sum() or cut.shape[2] % 2:
            return Model(centres, np.stack([np.resize(b, (words, b.shape[1])) for b in books]))
        parts *= 2


def encode(vectors: DataFrame, model: Model) -> DataFrame:
    """(vec_id, list, code) of every vector: its list, and a byte for each sub-vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, code = shared.value.encode(_unit(_matrix(pdf["embedding"])))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "list": own, "code": [c.tobytes() for c in code]})

    return vectors.select("vec_id", "embedding").mapInPandas(work, "vec_id long, list int, code binary")


def candidates(codes: DataFrame, queries: DataFrame, model: Model, probes: int, most: int) -> DataFrame:
    """(query_id, vec_id, near): for each query the ``most`` others of its ``probes`` nearest lists with the highest scores by their codes."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sizes = codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))  # at most MOST_LISTS rows
    blocks = max(1, -(-queries.count() // BLOCK))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q = _unit(_matrix(pdf["embedding"]))
                near = np.argsort(-(q @ shared.value.centres.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": pdf["vec_id"], "q": q.tolist(), "lists": near.tolist()})

    asked = queries.select("vec_id", "embedding").mapInPandas(ask, "query_id long, q array<double>, lists array<int>")
    asked = asked.select("query_id", "q", F.explode("lists").alias("list"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.join(F.broadcast(sizes), "list").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    held = codes.join(F.broadcast(sizes), "list").select("vec_id", "list", "code", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def cell(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "near": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(q) or not len(v):
            return none
        code, ids, own, at = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1), v["vec_id"].to_numpy(), q["query_id"].to_numpy(), _matrix(q["q"])
        out, half = [], shared.value.halves(key[0], code)
        for i in range(0, len(q), 64):  # 64 queries at a time bound the matrix of scores
            table = shared.value.tables(at[i : i + 64])
            s = (at[i : i + 64] @ shared.value.centres[key[0]])[:, None] + sum(table[:, j, code[:, j]] for j in range(code.shape[1])) - half
            s[own[i : i + 64, None] == ids[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :most]
            out.append(pd.DataFrame({"query_id": np.repeat(own[i : i + 64], top.shape[1]), "vec_id": ids[top].ravel(), "near": np.take_along_axis(s, top, 1).ravel()}))
        out = pd.concat(out)
        return out[np.isfinite(out["near"])]

    key = ["list", "slice", "block"]
    hits = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(cell, "query_id long, vec_id long, near double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))
    return hits.withColumn("_r", best).where(F.col("_r") <= most).drop("_r")


def refine(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of what was found, by cosine rounded to six places, then id."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    both = found.select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(q, "query_id")
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    score = F.round(dot(F.col("embedding"), F.col("q")) / (norm(F.col("embedding")) * norm(F.col("q"))), 6)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.select("query_id", "vec_id", score.alias("score")).withColumn("rank", best).where(F.col("rank") <= k)


class AnnIndex:
    """The codes of ``vectors`` as a work table, and what a search reads of them."""

    def __init__(self, vectors: DataFrame, parts: int = 8):
        self.vectors, self.model = vectors, fit(vectors, parts)
        self.codes = work_table(encode(vectors, self.model), "codes")

    def search(self, queries: DataFrame, k: int = 10, share: float = 0.1, refined: int = 8) -> DataFrame:
        """(query_id, vec_id, score, rank) from the nearest ``share`` of the lists."""
        return refine(candidates(self.codes, queries, self.model, self.probes(share), k * refined), self.vectors, queries, k)

    def probes(self, share: float) -> int:
        return max(1, round(len(self.model.centres) * share))

    def read_share(self, queries: DataFrame, share: float) -> float:
        """The part of all vectors whose codes a query reads, on average over all queries."""
        sizes = {r["list"]: r["count"] for r in self.codes.groupBy("list").count().collect()}  # at most MOST_LISTS rows
        each = np.array([sizes.get(i, 0) for i in range(len(self.model.centres))])
        probes, shared = self.probes(share), queries.sparkSession.sparkContext.broadcast((self.model.centres, each))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, each = shared.value
            for pdf in batches:
                for i in range(0, len(pdf), 256):  # 256 queries at a time bound the matrix of lists
                    near = np.argsort(-(_unit(_matrix(pdf["embedding"][i : i + 256])) @ centres.T), axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"n": [len(near)], "held": [int(each[near].sum())]})

        n, held = queries.select("embedding").mapInPandas(work, "n long, held long").agg(F.sum("n"), F.sum("held")).first()
        return held / n / max(1, int(each.sum())) if n else 0.0
