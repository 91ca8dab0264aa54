"""The registered queries opN_<name> of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cross_align, exact_topk, fingerprints, licenses, packing, parity_join, pii, secret_scan, shared, suffix_dedup, token_files, toxicity, zorder_layout

#: Fixed value: the id that closes a document in token files.
TOKEN_FILE_END = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "token-files")
    manifest = token_files.write_token_files(shared.documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), TOKEN_FILE_END)
    return token_files.read_token_files(spark, manifest)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_repeats(shared.documents(spark, sf_dir)).drop("spans")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(shared.documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_documents(shared.documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(shared.documents(spark, sf_dir))


def op6_short_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(shared.documents(spark, sf_dir), licenses.SHORT_TEMPLATES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels have two grades, so the model has one threshold here; with more grades it has one less than there are."""
    docs = shared.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(shared.documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 2,048 tokens a sequence.  The other two capacities, 2,048 documents and an attention cost of 2,048 squared, are those that this limit implies (a sum of squares is at most
    the square of the sum), so as few sequences as possible are used; the score still weighs all three residuals.  Callers set tighter ones by ``Capacity``."""
    pieces = packing.tokenize_pieces(shared.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0)
    narrow = pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign(narrow).drop("row")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(shared.documents(spark, sf_dir), ranks), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link for each group, since of a group's tokens only the last two end together."""
    both = cross_align.align_documents(shared.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    narrow = both.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), digest, "pairs", "times")
    return cross_align.score_links(narrow).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(shared.documents(spark, sf_dir))


def op13_zorder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = zorder_layout.place(zorder_layout.document_values(shared.documents(spark, sf_dir)), zorder_layout.DOCUMENTS)
    return placed.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_exact_topk": op5_exact_topk,
    "op6_license_scan": op6_license_scan,
    "op6_short_notices": op6_short_notices,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_cross_align": op11_cross_align,
    "op12_secret_scan": op12_secret_scan,
    "op13_zorder_layout": op13_zorder_layout,
}



def _license_sql(templates: dict[str, str], n: int) -> str:
    """The scan by plain containment of shingles of ``n`` words: every template against every window of its size class."""
    rows = [f"('{name}', {m}, {words})" for m, _, own in licenses.size_classes(templates, 0.75, 1e-4) for name, words in own]
    shingles = f"list_distinct(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i+{n - 1}], ' ')))"
    return f"""
        WITH t AS (SELECT license, m, {shingles} AS template FROM (VALUES {", ".join(rows)}) AS x(license, m, w)),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, m, start, w[start+1:start+2*m] AS w FROM (SELECT doc_id, w, m, unnest(range(0, len(w), m)) AS start FROM d, (SELECT DISTINCT m FROM t))),
        h AS (SELECT doc_id, license, start, len(list_intersect(s, template)) / len(template) AS share FROM (SELECT doc_id, m, start, {shingles} AS s FROM p) JOIN t USING (m))
        SELECT doc_id, license, round(max(share), 6) AS containment, count(*) AS n_windows, min(start)::BIGINT AS first_word FROM h WHERE share >= 0.75 GROUP BY 1, 2"""


def _layout_sql() -> str:
    """The layout by ranks over all rows and a join of cells with cells and files."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: xor(a >> 1, 3988292384 * (a & 1)))))"
    values = ["source", "lang", "length", "date"]
    names = ["s", "l", "len", "d"]
    ends = ", ".join(f"min({n}) AS a_{n}, max({n}) AS b_{n}" for n in names)
    bounds = ", ".join(f"a_{n}, b_{n}" for n in names)
    rank = ", ".join(f"(16 * (rank() OVER (ORDER BY {v} NULLS FIRST) - 1)) // count(*) OVER () AS {n}" for v, n in zip(values, names))
    z = " + ".join(f"((({n} >> {bit}) & 1) << {4 * bit + 3 - k})" for bit in range(4) for k, n in enumerate(["len", "s", "d", "l"]))
    return f"""
        WITH v AS (SELECT doc_id::BIGINT AS doc_id, source, lang, CASE WHEN text IS NULL THEN -1 ELSE strlen(text) END AS length, {crc} % 365 AS date FROM documents),
        c AS (SELECT doc_id, {rank} FROM v),
        z AS (SELECT *, {z} AS z FROM c),
        p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z),
        f AS (SELECT *, position // 500 AS file FROM p),
        b AS (SELECT file, {ends} FROM f GROUP BY 1),
        q AS (SELECT DISTINCT z, {", ".join(names)} FROM f),
        o AS (SELECT DISTINCT z, file, {", ".join(names)} FROM f),
        t AS (SELECT q.z, count(*) AS files_touched FROM q JOIN b ON q.s BETWEEN a_s AND b_s AND q.l BETWEEN a_l AND b_l
              AND a_len <= q.len + 2 AND b_len >= q.len - 2 AND a_d <= q.d + 2 AND b_d >= q.d - 2 GROUP BY 1),
        m AS (SELECT q.z, count(DISTINCT o.file) AS files_matching FROM q JOIN o ON q.s = o.s AND q.l = o.l AND abs(q.len - o.len) <= 2 AND abs(q.d - o.d) <= 2 GROUP BY 1)
        SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched, files_matching, concat_ws(',', {bounds}) AS file_bounds
        FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)"""


ORACLE_SQL: dict[str, str] = {
    "op13_zorder_layout": _layout_sql(),
    "op6_license_scan": _license_sql(licenses.TEMPLATES, licenses.WORDS),
    "op6_short_notices": _license_sql(licenses.SHORT_TEMPLATES, 3),
    "op5_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
