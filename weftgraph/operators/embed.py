"""Vectors of nodes and documents: what is embedded, how a store is kept true to its embedder, and an approximate index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunk import chunk_documents
from ..sources.shards import write_shard
from . import annindex, links, search, text

#: Signs of a symbol's documentation that are embedded; kinds that have vectors.
DOC_CHARS = 400
EMBEDDABLE = ["class", "function", "interface", "method", "namespace", "struct", "enum", "table", "view", "document"]


def node_text(nodes: DataFrame) -> Column:
    """What is embedded of a node: kind, name, the qualified name if it differs, file, signature and the start of its documentation."""
    attr = lambda k: F.get_json_object("attrs", f"$.{k}") if "attrs" in nodes.columns else F.lit(None).cast("string")
    qualified = F.when(F.col("qualified_name") != F.col("name"), F.col("qualified_name")) if "qualified_name" in nodes.columns else F.lit(None).cast("string")
    return F.concat_ws(" ", "kind", "name", qualified, "file", attr("signature"), F.substring(attr("doc"), 1, DOC_CHARS))


def embed_repo(nodes: DataFrame, path: str, kinds: list[str] | None = None, dim: int = 64, identity: str = "hashed-words") -> bool:
    """Replaces the vectors of the repositories in ``nodes`` at ``path`` (node_id, dim, identity, embedding by repo_id) and of no others.  False, with nothing written, where no node is of an
    embeddable kind, so that a shard of foreign kinds does not clear a store."""
    own = nodes.where(F.col("kind").isin(kinds or EMBEDDABLE))
    if not own.limit(1).count():
        return False
    rows = own.select("node_id", "repo_id", node_text(own).alias("text"))
    write_shard(rows.select("node_id", "repo_id", F.lit(dim).alias("dim"), F.lit(identity).alias("identity"), search.embed_batches(F.col("text"), dim).alias("embedding")), path)
    return True


def guard_identity(spark: SparkSession, path: str, dim: int, identity: str) -> None:
    """An error where the store holds vectors of another embedder or length; they must not be compared."""
    other = spark.read.parquet(path).where((F.col("dim") != dim) | (F.col("identity") != identity)).select("dim", "identity").first()
    if other is not None:
        raise ValueError(f"the store holds vectors of {other['identity']} with {other['dim']} places; embed it again for {identity} with {dim}")


def unpopulated_reason(vectors: DataFrame, nodes: DataFrame, repo: str | None = None) -> str | None:
    """Why a search by vectors can find nothing: no vectors, none of this repository, or nothing that could have one; None if it can."""
    if not vectors.limit(1).count():
        return "no vectors are stored"
    if repo is None or vectors.where(F.col("repo_id") == repo).limit(1).count():
        return None
    if not nodes.where((F.col("repo_id") == repo) & F.col("kind").isin(EMBEDDABLE)).limit(1).count():
        return f"{repo} has no node of a kind that is embedded"
    return f"{repo} has not been embedded"


def ingest(documents: DataFrame, symbols: DataFrame, nodes_path: str, vectors_path: str, edges_path: str, dim: int = 64) -> dict[str, int]:
    """Documents (doc_id, repo_id, title, text) become nodes of their partition, chunks with vectors, and links from the symbols (node_id, name) that they mention; each
    partition is replaced as a whole, so a second run leaves the same.  Returns the rows written."""
    spark = documents.sparkSession
    own = documents.withColumn("repo_id", F.concat(F.lit("@connect:"), F.col("repo_id")))
    node = own.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("node_id"), "repo_id", F.lit("document").alias("kind"), F.coalesce("title", F.lit("")).alias("name"))
    write_shard(node, nodes_path)
    chunks = chunk_documents(documents).join(own.select("doc_id", "repo_id"), "doc_id")
    vectors = chunks.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("|"), F.col("chunk_ix").cast("string")).alias("node_id"), "repo_id", F.lit(dim).alias("dim"), F.lit("hashed-words").alias("identity"), search.embed_batches(F.col("chunk"), dim).alias("embedding"))
    write_shard(vectors, vectors_path)
    found = text.symbol_mentions(documents, symbols).withColumn("confidence", F.lit("AMBIGUOUS"))
    linked = links.link_documents(found, documents, "documented_by").join(own.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dst"), "repo_id"), "dst")
    write_shard(linked, edges_path)
    count = lambda path: spark.read.parquet(path).count()
    return {"nodes": count(nodes_path), "chunks": count(vectors_path), "edges": count(edges_path)}


def ann_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.1, refined: int = 8) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest other vectors by cosine among what the nearest ``share`` of the lists hold (see ``annindex``).  Exact search is ``search.vector_topk`` or
    ``search.knn_edges``; ``recall`` measures this one against it."""
    return annindex.AnnIndex(vectors).search(queries, k, share, refined)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query_id, vec_id) that were found."""
    n = exact.count()
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
