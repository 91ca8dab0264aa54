"""The corpus pipeline: toxicity filter, near duplicates, suffix deduplication, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  ``run``
applies them to documents, each result written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import packing, parity_join, pii, shared, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, fitted on labelled documents of its input, does not reject.  Each row is judged by its own text, so repeated rows stay or go
    together; null and empty texts hold no word and stay; columns of any name are kept."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, that with the smallest doc_id (null last).  Each row is judged by its own text, whatever its
    doc_id; texts without words are linked with nothing and stay."""
    return parity_join.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that start in a document with a smaller doc_id.  Null texts become empty ones; rows with a null doc_id neither remove nor lose anything, rows that share
    one do not affect each other, equal rows stay; a text that is removed whole stays as an empty one; columns of any name are kept."""
    return suffix_dedup.drop_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced by their kinds.  Null texts stay null; each row is masked by its own text, so repeated rows and ids, and null ids, stay as they
    are; columns of any name are kept."""
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids, its sequence and its place there.  Null texts count as empty and give their end id; repeated rows, ids and null ids are packed once for each
    row; other columns are left out, whatever their names."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0).drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("suffix deduplication", drop_repeats),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: No stage but the first steps of two has an SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
