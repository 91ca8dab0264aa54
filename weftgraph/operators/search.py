"""Lexical, vector and hybrid retrieval, and its measures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import small, work_table
from . import pagerank

#: Column weights and constants of the ranking.
WEIGHTS = {"name": 10.0, "qualified_name": 3.0, "file": 1.0}
K1, B = 1.2, 0.75


def query_terms(text: str) -> list[str]:
    """Terms of a query: signs become blanks; each is a prefix, and all must match."""
    return [t.lower() for t in re.sub(r"[^\w\s]", " ", text).split()]


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of lower-cased words; terms are counted within each task first."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))).alias("term")
    return docs.select(key, words).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int = 10) -> DataFrame:
    """The best documents that hold every term, by BM25 rounded to six places, ties by key."""
    terms = query_terms(query)
    sizes = docs.select(key, F.size(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))).alias("len"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = postings(docs, key, text).where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a query term
    scored = hits.join(F.broadcast(df), "term").join(sizes, key).join(F.broadcast(totals))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    whole = scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(terms)))
    return whole.select(key, "score").orderBy(F.desc("score"), key).limit(limit)


def _begins(text: Column, term: str) -> Column:
    return F.size(F.filter(F.split(text, r"[^a-z0-9]+"), lambda w: w.startswith(term)))


def fts(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Nodes of which every query term begins some word: exact names first, then names that begin with the query, then by weighted term frequency."""
    text = lambda c: F.coalesce(F.lower(c), F.lit(""))
    columns = [c for c in WEIGHTS if c in nodes.columns]
    cond, score = F.lit(True), F.lit(0.0)
    for t in query_terms(query):
        found = {c: _begins(text(c), t) for c in columns}
        cond = cond & (sum(found.values(), F.lit(0)) > 0)
        score = score + sum((F.least(n, F.lit(1)) * WEIGHTS[c] for c, n in found.items()), F.lit(0.0))
    q = query.lower()
    hits = nodes.where(cond).select("node_id", "name", (F.lower("name") == q).alias("exact"), F.lower("name").startswith(q).alias("prefix"), F.round(score, 4).alias("score"))
    return hits.orderBy(F.desc("exact"), F.desc("prefix"), F.desc("score"), "node_id").limit(limit)


def fts_bm25(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(node_id, name, exact, prefix, score): nodes of which every query term begins some word; exact names first, then names that begin with the query, then by BM25 over the
    columns together, a word counting by its column's weight; a term that most nodes hold keeps a small weight above zero.

    One scan counts words for each term and column; the totals are one row, so nothing but the hits' order is shuffled.
    """
    columns = [c for c in WEIGHTS if c in nodes.columns]
    terms = list(dict.fromkeys(query_terms(query)))
    words = {c: F.filter(F.split(F.coalesce(F.lower(c), F.lit("")), r"[^a-z0-9]+"), lambda w: w != "") for c in columns}

    def weighted(term: str) -> Column:
        return sum((F.size(F.filter(words[c], lambda w: w.startswith(term))) * F.lit(WEIGHTS[c]) for c in columns), F.lit(0.0))

    rows = nodes.select("node_id", "name", sum((F.size(words[c]) for c in columns), F.lit(0)).alias("len"), *[weighted(t).alias(f"f{i}") for i, t in enumerate(terms)])
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("a"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    met = rows
    for i in range(len(terms)):
        met = met.where(F.col(f"f{i}") > 0)
    idf = lambda i: F.greatest(F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(1e-6))
    part = lambda i: idf(i) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("len") / F.col("a")))
    score = sum((part(i) for i in range(len(terms))), F.lit(0.0))
    q = query.lower()
    hits = met.join(F.broadcast(totals)).select("node_id", "name", (F.lower("name") == q).alias("exact"), F.lower("name").startswith(q).alias("prefix"), F.round(score, 4).alias("score"))
    return hits.orderBy(F.desc("exact"), F.desc("prefix"), F.desc("score"), "node_id").limit(limit)


def begins(words: Column, term: str) -> Column:
    """Whether some word of an array begins with a term."""
    return F.exists(words, lambda w: w.startswith(term))


def fts_any(nodes: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """Nodes of which some word of the name or file begins with one of the terms, by how many do, then by id."""
    words = F.split(F.lower(F.concat_ws(" ", "name", "file")), r"[^a-z0-9]+")
    n = sum((begins(words, t.lower()).cast("int") for t in terms), F.lit(0))
    return nodes.select("node_id", "name", n.alias("score")).where("score > 0").orderBy(F.desc("score"), "node_id").limit(limit)


def below_floor(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(n_matched, n_unmatched, below): a question is below the floor if some terms match nothing and none matches."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1)))
    any_of = docs.select(*[F.array_contains(words, t).alias(f"t{i}") for i, t in enumerate(terms)])
    hit = any_of.agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(terms))])
    n = sum((F.coalesce(F.col(f"t{i}"), F.lit(False)).cast("long") for i in range(len(terms))), F.lit(0).cast("long"))
    return hit.select(n.alias("n_matched"), (F.lit(len(terms)) - n).alias("n_unmatched"), ((n == 0) & F.lit(bool(terms))).alias("below"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; a zero norm counts as one."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    x, y = wide(a), wide(b)
    return dot(x, y) / (norm(x) * norm(y))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k most similar vectors of the query's dimension, by cosine rounded to four places and id: one scan and a bounded top-k."""
    same = vectors.where(F.size("embedding") == len(query))
    q = F.array(*[F.lit(float(x)) for x in query])
    return same.select("vec_id", F.round(cosine(F.col("embedding"), q), 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def collapse_chunks(scored: DataFrame, k: int) -> DataFrame:
    """The best chunk of each node, then the k best nodes."""
    return scored.groupBy("node_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def _best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best others for each of the unit vectors ``q``, ties to smaller ids.  Products in single precision leave what can be among the first k; those are compared by
    their rounded scores in double precision.  Where ties leave too much, a block is sorted whole."""
    xs, k, out = x.astype(np.float32), min(k, len(x)), []
    for i in range(0, len(q), rows):
        b, mine = q[i : i + rows], own[i : i + rows]
        near = b.astype(np.float32) @ xs.T
        at, same = np.nonzero(mine[:, None] == ids[None, :]) if np.isin(mine, ids).any() else (np.zeros(0, int), np.zeros(0, int))
        near[at, same] = -9
        r, c = np.nonzero(near >= np.partition(near, len(x) - k, axis=1)[:, len(x) - k, None] - 1e-5)  # beyond both the error of single precision and the rounding
        if len(r) <= 16 * k * len(b):
            s = np.round(np.einsum("ij,ij->i", b[r], x[c]), 6)
            s[near[r, c] == -9] = -9
        else:
            full = np.round(b @ x.T, 6)
            full[at, same] = -9
            r, c = np.nonzero(full >= np.partition(full, len(x) - k, axis=1)[:, len(x) - k, None])
            s = full[r, c]
        order = np.lexsort((ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        keep = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (s > -9)
        out.append((mine[r[keep]], ids[c[keep]], s[keep]))
    return tuple(np.concatenate(z) for z in zip(*out))


def knn_edges(vectors: DataFrame, k: int = 3, block: int = 4096, queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, score) of each vector's k nearest others by cosine rounded to six places, or of ``queries`` alone: blocks of vectors meet blocks of queries, each pair of blocks is one matrix product,
    taken some rows at a time."""
    asked = vectors if queries is None else queries
    n = max(1, -(-vectors.count() // block))
    m = n if queries is None else max(1, -(-asked.count() // block))
    dealt = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    grid = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select("vec_id", "embedding", dealt(n).alias("b"), grid(m).alias("q"))
    right = asked.select("vec_id", "embedding", dealt(m).alias("q"), grid(n).alias("b"))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        unit = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
        if not len(x) or not len(y):
            return pd.DataFrame({"src": [], "dst": [], "score": []}).astype({"src": "int64", "dst": "int64"})
        a, b = np.stack(x["embedding"]).astype(float), np.stack(y["embedding"]).astype(float)
        return pd.DataFrame(dict(zip(("src", "dst", "score"), _best_of(unit(a), x["vec_id"].to_numpy(), unit(b), y["vec_id"].to_numpy(), k))))

    hits = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(cell, "src long, dst long, score double")
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return hits.withColumn("r", best).where(F.col("r") <= k).select("src", "dst", "score")


def hybrid_rank(edges: DataFrame, seeds: DataFrame, k: int = 10, hops: int = 2) -> DataFrame:
    """(query_id, node_id, score) of many queries: the neighbourhood of a query's seeds (query_id, id, score) within ``hops``, ranked by personalized PageRank on it; scores
    are rounded to six places, ties go to the smaller id.  Frontiers are broadcast only where their size is checked and small."""
    edges = work_table(edges.select("src", "dst"), "ranked-edges")  # every hop and the push read them; what made them runs once
    both = work_table(edges.union(edges.select("dst", "src")).distinct(), "both-ways")
    near = seeds.select("query_id", "id").distinct()
    found = both.select(F.lit(None).cast(near.schema["query_id"].dataType).alias("query_id"), "src", "dst").limit(0)
    for _ in range(hops):
        side = F.broadcast(near) if small(near) else near
        step = both.join(side, F.col("src") == F.col("id")).select("query_id", "src", "dst")
        found = found.union(step)
        near = step.select("query_id", F.col("dst").alias("id")).union(near).distinct()
    scored = pagerank.push(work_table(found, "near-edges"), work_table(seeds, "seeds")).withColumn("score", F.round("score", 6))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return scored.withColumn("r", best).where(F.col("r") <= k).select("query_id", "node_id", "score")


def hybrid(vectors: DataFrame, edges: DataFrame, query: list[float], k: int = 10, seeds: int = 20, hops: int = 2) -> DataFrame:
    """(node_id, score) of one query: seeds by cosine, their neighbourhood ranked by ``hybrid_rank``."""
    first = vector_topk(vectors, query, seeds).select(F.lit(0).cast("long").alias("query_id"), F.col("vec_id").alias("id"), "score")
    return hybrid_rank(edges, first, k, hops).select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(k)


def retrieval_metrics(ranked: DataFrame, golden: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, precision, recall, rr, hit): precision over the rows retrieved in the first k; the reciprocal rank over all retrieved.  With ``sizes`` (query_id, n_good) golden need only
    hold the pairs that were retrieved."""
    g = golden.select("query_id", "node_id").distinct().withColumn("good", F.lit(1))
    rows = ranked.join(g, ["query_id", "node_id"], "left")
    per = rows.groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("long")).alias("n_top"), F.sum(F.when(F.col("rank") <= k, F.coalesce("good", F.lit(0))).otherwise(0)).alias("n_hit"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first")
    )
    sizes = sizes if sizes is not None else g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_good"))
    p = sizes.join(per, "query_id", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return p.select("query_id", F.round(F.when(F.coalesce("n_top", F.lit(0)) > 0, hit / F.col("n_top")).otherwise(0.0), 4).alias("precision"), F.round(hit / F.col("n_good"), 4).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("rr"), (hit > 0).alias("hit"))


def as_of_search(nodes: DataFrame, commit: str, text: str, limit: int = 50) -> DataFrame:
    """Names that hold ``text`` in one snapshot."""
    return nodes.where((F.col("commit") == commit) & F.lower("name").contains(text.lower())).orderBy("node_id").limit(limit)


def embed_batches(texts: Column, dim: int = 64) -> Column:
    """A deterministic embedder: signed hashed word counts, scaled to unit length."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        for s in batches:
            out = []
            for t in s.fillna(""):
                v = np.zeros(dim)
                for w in re.findall(r"\w+", t.lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 16 & 1 else -1
                out.append((v / (np.linalg.norm(v) or 1)).astype("float32"))
            yield pd.Series(out)

    return embed(texts)


def run_summary(metrics: DataFrame, ranked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One row for a run: means of precision, recall, reciprocal rank and hits, the mean of the tokens that the first k answers cost, and precision for each 1,000 of them (0 where there are none).
    An answer costs a token for each four signs of its kind, qualified name (else name) and file, one at least."""
    name = F.coalesce("qualified_name", "name") if "qualified_name" in nodes.columns else F.col("name")
    cost = F.greatest(F.lit(1), F.floor(F.length(F.concat(F.col("kind"), F.lit(" "), name, F.lit(" "), F.coalesce("file", F.lit("")))) / 4)).cast("long")
    tokens = ranked.where(F.col("rank") <= k).join(nodes.select("node_id", cost.alias("t")), "node_id").groupBy("query_id").agg(F.sum("t").alias("t"))
    rows = metrics.join(tokens, "query_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    mean = rows.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("rr").alias("mrr"), F.avg(F.col("hit").cast("int")).alias("h"), F.avg("t").alias("t"), F.count(F.lit(1)).alias("n_queries"))
    per = F.when(F.col("t") > 0, F.col("p") / (F.col("t") / 1000)).otherwise(0.0)
    return mean.select("n_queries", *[F.round(c, 4).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("mrr", "mrr"), ("h", "hit_rate"), ("t", "est_tokens"))], F.round(per, 4).alias("precision_per_1k"))
