"""A stored inverted index for prefix search by BM25 over weighted columns: the rows that ``search.fts_bm25`` finds by reading every node.

``postings`` has one row for each term of a node (weighted frequency, words of the node, block), in folders by the term's first two signs and
sorted by term within them: a prefix is a scan of one folder, and row groups are skipped by the terms they span.  A block holds nodes of
one length, so ``blocks``, with the largest frequency of each term in each block, bounds every score there.  A search scores the blocks of the
highest bounds first and then only those whose bound reaches the k-th score found; blocks of nodes that are named like the query are always read,
since these come first.  Rows of changed nodes are added as a generation; what they replace is listed as dead until ``compact`` writes one generation anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import settings, tasks_for, work_table
from .search import B, K1, WEIGHTS, query_terms

_SCHEMAS = {
    "names": "node_id string, name string, lname string, len long, block string, gen long, lead string",
    "postings": "term string, node_id string, len long, block string, gen long, wtf double, lead string",
    "blocks": "term string, block string, len long, most double, n long, gen long, lead string",
    "totals": "n long, len long",
    "slices": "len long, slices long",
    "dead": "node_id string, gen long, len long",
}
#: Blocks that are scored before the bound is known, for each row that is asked for.
FIRST_BLOCKS = 2


def _words(column: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.lower(F.col(column)), F.lit("")), r"[^a-z0-9]+"), "")


def _lead(text: Column) -> Column:
    """The folder of a term or name: its first two signs, in hexadecimal so that any sign may stand in a path."""
    return F.concat(F.lit("x"), F.coalesce(F.lower(F.hex(F.encode(F.substring(text, 1, 2), "utf-8"))), F.lit("")))


class TextIndex:
    """An index at ``path``.  ``block_nodes`` is about how many nodes of one length share a block."""

    def __init__(self, spark: SparkSession, path: str, block_nodes: int = 1024):
        self._spark, self._path, self._block = spark, path, block_nodes

    # ---- writing

    def build(self, nodes: DataFrame) -> None:
        """Replaces the index by one of ``nodes`` (node_id unique, name, and any of qualified_name and file)."""
        self._write(nodes, 0, "overwrite")
        self._spark.range(0).select(F.lit("").alias("node_id"), F.col("id").alias("gen"), F.col("id").alias("len")).write.mode("overwrite").parquet(f"{self._path}/dead")

    def _write(self, nodes: DataFrame, gen: int, mode: str) -> None:
        own = [c for c in WEIGHTS if c in nodes.columns]
        dealt = nodes.withColumn("node_id", F.col("node_id").cast("string")).repartition("node_id")  # files of few kinds would make few long tasks
        words = dealt.select("node_id", "name", *[_words(c).alias(f"_{c}") for c in own])
        rows = work_table(words.withColumn("len", sum((F.size(f"_{c}") for c in own), F.lit(0)).cast("long")), "index-rows")  # texts are cut once
        n, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        # Nodes of a length are dealt to so many blocks that one has about ``block_nodes`` of them; the number is fixed with the first generation.
        if not gen:
            slices = rows.groupBy("len").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / self._block)).cast("long").alias("slices"))
            slices.write.mode("overwrite").parquet(f"{self._path}/slices")
        placed = rows.join(self._read("slices"), "len", "left").withColumn("block", F.concat_ws("-", F.col("len").cast("string"), F.pmod(F.xxhash64("node_id"), F.coalesce("slices", F.lit(1))).cast("string")))
        docs = placed.select("node_id", "name", F.lower("name").alias("lname"), "len", "block")
        self._store("names", docs, gen, mode, n)
        # A node's terms are counted within its row, so nothing has to be grouped.
        each = placed.withColumn("term", F.explode(F.array_distinct(F.concat(*[f"_{c}" for c in own]))))
        weight = sum(((F.size(f"_{c}") - F.size(F.array_remove(f"_{c}", F.col("term")))) * F.lit(WEIGHTS[c]) for c in own), F.lit(0.0))
        each = each.select("term", "node_id", "len", "block", weight.alias("wtf"))
        self._store("postings", each, gen, mode, length)
        stored = self._read("postings").where(F.col("gen") == gen)
        tops = stored.groupBy("term", "block", "len").agg(F.max("wtf").alias("most"), F.count(F.lit(1)).alias("n"))
        self._store("blocks", tops, gen, mode, length)
        self._spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(length).cast("long").alias("len")).write.mode(mode).parquet(f"{self._path}/totals")

    def _store(self, what: str, rows: DataFrame, gen: int, mode: str, size: int) -> None:
        """Writes rows of a generation to their folders, in order.  They are dealt by ranges that end within a folder and within equal names or terms too, as one folder may hold most of the rows."""
        text, place = ("lname", "node_id") if what == "names" else ("term", "block")
        tasks = tasks_for(self._spark, size)
        with settings(self._spark, {"spark.sql.shuffle.partitions": str(tasks)}):
            dealt = rows.repartitionByRange(tasks, text, place).withColumn("gen", F.lit(gen).cast("long")).withColumn("lead", _lead(F.col(text)))
            dealt.sortWithinPartitions("lead", text).write.mode(mode).partitionBy("lead").parquet(f"{self._path}/{what}")

    def _read(self, what: str) -> DataFrame:
        return self._spark.read.schema(_SCHEMAS[what]).parquet(f"{self._path}/{what}")

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._read("dead").select("node_id", "gen"), ["node_id", "gen"], "left_anti")

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Puts ``changed`` nodes in place of what the index holds of them and takes ``removed`` (node_id) out; other nodes' rows are not written again."""
        gone = changed.select(F.col("node_id").cast("string").alias("node_id"))
        if removed is not None:
            gone = gone.union(removed.select(F.col("node_id").cast("string")))
        old = self._alive(self._read("names").select("node_id", "gen", "len").join(gone.distinct(), "node_id", "left_semi"))
        gen = (self._read("names").agg(F.max("gen")).first()[0] or 0) + 1
        with settings(self._spark, {"spark.sql.shuffle.partitions": str(tasks_for(self._spark, self._totals()[0]))}):
            old.write.mode("append").parquet(f"{self._path}/dead")
        self._write(changed, gen, "append")

    def compact(self, path: str) -> TextIndex:
        """The same index at another ``path`` in one generation, without what is dead; the old one may be dropped then."""
        out = TextIndex(self._spark, path, self._block)
        n, average = self._totals()
        for what, size in (("names", n), ("postings", n * average)):  # dead rows are told by node and generation
            out._store(what, self._alive(self._read(what)).drop("gen", "lead"), 0, "overwrite", int(size))
        tops = out._read("postings").groupBy("term", "block", "len").agg(F.max("wtf").alias("most"), F.count(F.lit(1)).alias("n"))
        out._store("blocks", tops, 0, "overwrite", int(n * average))
        out._read("names").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).write.mode("overwrite").parquet(f"{path}/totals")
        self._read("slices").write.mode("overwrite").parquet(f"{path}/slices")
        self._read("dead").limit(0).write.mode("overwrite").parquet(f"{path}/dead")
        return out

    # ---- reading

    def prefix(self, what: str, column: str, text: str) -> DataFrame:
        """The rows of a table whose ``column`` begins with ``text``: one folder, unless it is a single sign."""
        rows = self._read(what)
        head = "x" + text[:2].encode().hex()
        rows = rows.where(F.col("lead") == head) if len(text) >= 2 else rows.where(F.col("lead").startswith(head))
        return rows.where(F.col(column).startswith(text))

    def _totals(self) -> tuple[int, float]:
        all_, dead = self._read("totals").agg(F.sum("n"), F.sum("len")).first(), self._read("dead").agg(F.count(F.lit(1)), F.sum("len")).first()
        n, words = (all_[0] or 0) - dead[0], (all_[1] or 0) - (dead[1] or 0)
        return n, words / n if n else 0.0

    def _score(self, terms: list[str], idf: list[float], average: float, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
        """(node_id, gen, block, score) of nodes with every term, among the postings that ``keep`` leaves."""
        held = self._held(terms, keep).groupBy("node_id", "gen", "block", "len").agg(*[F.sum(F.when(F.col("i") == i, F.col("wtf"))).alias(f"f{i}") for i in range(len(terms))])
        score = sum((_weight(F.col(f"f{i}"), F.col("len"), F.lit(x), average) for i, x in enumerate(idf)), F.lit(0.0))
        return held.dropna(subset=[f"f{i}" for i in range(len(terms))]).select("node_id", "gen", "block", score.alias("score"))

    def _held(self, terms: list[str], keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
        """(node_id, gen, block, len, wtf, i) of the postings of the terms, by number, without those of dead nodes: they meet these once, by node and generation, and can be grouped by both where they lie."""
        each = [keep(self.prefix("postings", "term", t)).select("node_id", "gen", "block", "len", "wtf", F.lit(i).alias("i")) for i, t in enumerate(terms)]
        return self._alive(reduce(DataFrame.unionByName, each))

    def bounds(self, terms: list[str], idf: list[float], average: float) -> DataFrame:
        """(block, bound): no node of the block has a higher score; blocks that lack a term are left out."""
        each = [self.prefix("blocks", "term", t).select("block", "len", F.lit(i).alias("i"), "most", "term", "gen") for i, t in enumerate(terms)]
        # A node's frequency of a prefix is at most the sum of its terms' largest ones; of several generations the largest counts.
        f = reduce(DataFrame.unionByName, each).groupBy("block", "len", "i", "term").agg(F.max("most").alias("m")).groupBy("block", "len", "i").agg(F.sum("m").alias("f"))
        part = _weight(F.col("f"), F.col("len"), F.element_at(F.array(*[F.lit(x) for x in idf]), F.col("i") + 1), average)
        whole = f.withColumn("p", part).groupBy("block").agg(F.sum("p").alias("bound"), F.count(F.lit(1)).alias("k"))
        return whole.where(F.col("k") == len(terms)).select("block", "bound")

    def blocks_for(self, terms: list[str], idf: list[float], average: float, named: DataFrame, limit: int) -> DataFrame:
        """(block) of the blocks that may hold one of the ``limit`` best: those of the highest bounds are scored first, and the last of their scores is the others' floor."""
        bound = work_table(self.bounds(terms, idf, average), "bounds")
        first = F.broadcast(bound.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS * limit).select("block"))
        best = self._score(terms, idf, average, lambda rows: rows.join(first, "block", "left_semi")).orderBy(F.desc("score")).limit(limit)
        floor, found = best.agg(F.min("score"), F.count(F.lit(1))).first()
        if found < limit:
            return bound.select("block")
        return bound.where(F.col("bound") >= floor - 1e-4).select("block").union(named.select("block")).distinct()  # scores are rounded to four places

    def statistics(self, query: str) -> tuple[list[str], list[float], float]:
        """The terms of a query, their inverse document frequencies, and the nodes' average length; no terms where nothing can match."""
        terms = list(dict.fromkeys(query_terms(query)))
        n, average = self._totals()
        if not n or any(not t.isascii() or "_" in t for t in terms):  # words hold ASCII letters and digits only
            return [], [], average
        df = {}
        if terms:
            each = self._held(terms).groupBy("node_id", "gen").agg(*[F.max(F.col("i") == i).cast("long").alias(f"d{i}") for i in range(len(terms))])
            df = dict(enumerate(each.agg(*[F.coalesce(F.sum(f"d{i}"), F.lit(0)) for i in range(len(terms))]).first()))
        return terms, [max(log((n - df[i] + 0.5) / (df[i] + 0.5)), 1e-6) for i in range(len(terms))], average

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """(node_id, name, exact, prefix, score), as ``search.fts_bm25`` gives them."""
        terms, idf, average = self.statistics(query)
        q = query.lower()
        if not terms:
            return self._read("names").limit(0).select("node_id", "name", F.lit(True).alias("exact"), F.lit(True).alias("prefix"), F.lit(0.0).alias("score"))
        named = self._alive(self.prefix("names", "lname", q)).select("node_id", "gen", "block", "lname")
        kept = work_table(self.blocks_for(terms, idf, average, named, limit), "blocks")
        hits = self._score(terms, idf, average, lambda rows: rows.join(kept, "block", "left_semi")).withColumn("score", F.round("score", 4))
        # Nodes named like the query come first; the best are told without the others' names.
        marked = hits.join(named.select("node_id", "gen", "lname"), ["node_id", "gen"], "left")
        best = marked.orderBy(F.desc(F.coalesce(F.col("lname") == q, F.lit(False))), F.desc(F.col("lname").isNotNull()), F.desc("score"), "node_id").limit(limit).select("node_id", "gen", "score")
        out = self._read("names").join(F.broadcast(best), ["node_id", "gen"])
        out = out.select("node_id", "name", (F.col("lname") == q).alias("exact"), F.col("lname").startswith(q).alias("prefix"), "score")
        return out.orderBy(F.desc("exact"), F.desc("prefix"), F.desc("score"), "node_id").limit(limit)


def _weight(f: Column, size: Column, idf: Column, average: float) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.lit(float(average or 1))))
