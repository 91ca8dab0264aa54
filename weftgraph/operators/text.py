"""Text operators: extraction of endpoints, topics, keys and links, and quality gates."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import small
from .names import names_in

#: Spans and repeats at which a page is refused.
LEAK_WORDS, MOST_REPEATS = 12, 8


def normalize_path(url: Column) -> Column:
    """The path of an endpoint: no scheme, host, query or fragment; parameters, numbers and long hex become {}."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    segment = lambda s: F.when(s.rlike(r"^[{:$]|\$\{|^[0-9]+$|^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{16,}$"), "{}").otherwise(s)
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), segment)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def raw_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def normalize_topic(topic: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(topic, ":", -1), "/", -1))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))


def issue_keys(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][A-Z0-9]+-[0-9]+)"), F.lit(1)))


def link_kind(url: Column) -> Column:
    """Which system a link belongs to, by host."""
    host = raw_host(url)
    return (
        F.when(host.rlike(r"(^|\.)atlassian\.net$"), "atlassian").when(host.rlike(r"(^|\.)figma\.com$"), "figma").when(host.rlike(r"(^|\.)slack\.com$"), "slack").when(host.rlike(r"(^|\.)zendesk\.com$"), "zendesk").otherwise("other")
    )


def safe_url(url: Column) -> Column:
    return F.when(F.lower(url).rlike(r"^(https?://|mailto:)"), url)


def sanitize_label(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), 1, 256)


def untrusted_block(text: Column) -> Column:
    """Text between markers that carry its digest, with marker-like lines taken out of it."""
    body = F.regexp_replace(text, r"(?m)^<<<.*>>>$", "")
    mark = F.substring(F.sha2(body, 256), 1, 8)
    return F.concat(F.lit("<<<untrusted "), mark, F.lit(">>>\n"), body, F.lit("\n<<<end "), mark, F.lit(">>>"))


#: Fixed value: what of a path behind a root's placeholder becomes a digest.
UNDER_ROOT = r"(<workspace>|<group>)/(?!repo-)([\w.@+-]+(?:/[\w.@+-]+)*)"


def digest(name: str) -> str:
    """The short digest that stands for a name; the same name has the same one everywhere."""
    return "repo-" + hashlib.blake2s(name.encode("utf-8", "replace"), digest_size=4).hexdigest()


def redact(text: Column, names: list[str], prefixes: dict[str, str] | None = None, literals: dict[str, str] | None = None) -> Column:
    """A text without what tells whose it is: path prefixes and literals become their placeholders, known names, longest first and only where no word, dot or dash goes on, become digests, and so does what lies
    under the placeholder of a root.  In Arrow batches, since Spark has no function for the digest and none that computes a replacement."""
    from pyspark.sql.functions import pandas_udf

    plain = [*sorted((prefixes or {}).items(), key=lambda x: -len(x[0])), *(literals or {}).items()]
    known = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)) if n)
    named = re.compile(rf"(?<![\w.-])(?:{known})(?![\w.-])") if known else None

    @pandas_udf("string")
    def work(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            for old, new in plain:
                t = t.replace(old, new)
            t = named.sub(lambda m: digest(m[0]), t) if named else t
            return re.sub(UNDER_ROOT, lambda m: f"{m[1]}/{digest(m[2])}", t)

        return column.map(one)

    return work(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def _bound(x: Column, use) -> Column:
    """``use`` of ``x`` with x computed once, however often the result refers to it: a lambda's variable binds it."""
    return F.transform(F.array(x), use)[0]


def spans(text: Column, n: int) -> Column:
    """Hashes of the n words from each place on; linear in the length of the text."""

    def of(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))

    return _bound(words(text), of)


def leaked_spans(docs: DataFrame, protected: DataFrame, n: int = LEAK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_spans) of spans of n words that a document shares with a protected text.  Where the protected spans are few they are broadcast
    and the documents' spans are never shuffled; where they are many, hashes alone are."""
    own = protected.select("item_id", F.explode(F.array_distinct(spans(F.col("text"), n))).alias("h"))
    seen = docs.select("doc_id", F.explode(F.array_distinct(spans(F.col("text"), n))).alias("h"))
    own = F.broadcast(own) if small(own) else own
    return seen.join(own, "h").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_spans"))


def most_repeated(docs: DataFrame, least_words: int = LEAK_WORDS) -> DataFrame:
    """(doc_id, n_repeats, looping) of a document's most repeated long line."""
    line = F.explode(F.split("text", "\n")).alias("line")
    long = docs.select("doc_id", line).where(F.size(words(F.col("line"))) >= least_words).groupBy("doc_id", F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("doc_id").agg(F.max("n").alias("n_repeats")).withColumn("looping", F.col("n_repeats") > MOST_REPEATS)


#: What ends a line, and a sentence within it.
LINE_END, SENTENCE_END = r"[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]", r"(?<=[.!?])[\t\x1f\p{Zs}]+"


def _most_equal(hashes: Column) -> Column:
    """How often the most frequent value of an array stands in it; 0 if the array is empty."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, h: Column) -> Column:
        run = F.when(acc["last"] == h, acc["run"] + 1).otherwise(1)
        return F.struct(h.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(hashes), start, step, lambda acc: acc["best"])


def repeats(docs: DataFrame, least_words: int = LEAK_WORDS, most: int = MOST_REPEATS) -> DataFrame:
    """(doc_id, n_sentence, n_span, looping) of each row: how often its most repeated sentence of at least ``least_words`` words stands in it, and
    its most repeated span of as many words within a line.  Words are lower-cased, list marks and other signs do not count."""
    lines = F.split(F.coalesce("text", F.lit("")), LINE_END)
    sentences = F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, SENTENCE_END), words))), lambda w: F.size(w) >= least_words)

    def starts(w: Column) -> Column:
        last = F.size(w) - least_words
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(w, i, least_words)))).otherwise(F.array().cast("array<bigint>"))

    found = docs.select("doc_id", _most_equal(F.transform(sentences, lambda w: F.xxhash64(w))).alias("n_sentence"), _most_equal(F.flatten(F.transform(F.transform(lines, words), starts))).alias("n_span"))
    return found.withColumn("looping", F.greatest("n_sentence", "n_span") > most)


def symbol_mentions(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, node_id) of symbols of at least three signs that a text names as a whole word."""
    own = symbols.where(F.length("name") >= 3).select("node_id", "name")
    return names_in(docs, own).join(own, "name").select("doc_id", "node_id").distinct()


def mentions(docs: DataFrame, symbols: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(doc_id, node_id, confidence) of symbols of at least three signs that a text names as whole words, whatever signs the names hold: INFERRED where one node has the name, else AMBIGUOUS."""
    own = symbols.where(F.length("name") >= 3)
    own = own.where(F.col("kind").isin(kinds)) if kinds else own
    own = own.select("node_id", "name").distinct()
    named = own.join(own.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name")
    return names_in(docs, own).join(named, "name").select("doc_id", "node_id", F.when(F.col("n") == 1, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"))


def secret_like(text: Column) -> Column:
    return text.rlike(r"(?i)(password|secret|token|api[_-]?key)\s*[=:]\s*\S+|AKIA[0-9A-Z]{12,}")


def table_refs(text: Column) -> Column:
    """Tables that embedded SQL reads, as an array of lower-cased names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-z_][a-z0-9_.]*)"), F.lit(1)), lambda s: F.lower(s)))


def cited(lines: DataFrame, citations: DataFrame, window: int = 2) -> DataFrame:
    """(cite_id, status, reason) of citations (cite_id, file, line, name) against file lines (file, line, text): verified, broken or unverifiable."""
    files = lines.groupBy("file").agg(F.max("line").alias("last"))
    near = citations.join(lines.select("file", F.col("line").alias("at"), "text"), "file").where((F.abs(F.col("at") - F.col("line")) <= window) & F.col("text").contains(F.col("name"))).select("cite_id").distinct().withColumn("ok", F.lit(True))
    rows = citations.join(files, "file", "left").join(near, "cite_id", "left")
    reason = F.when(F.col("line").isNull(), "no_citation").when(F.col("last").isNull(), "file_missing").when(F.col("line") > F.col("last"), "line_out_of_range").when(F.col("ok").isNull(), "name_absent")
    status = F.when(F.col("line").isNull(), "unverifiable").when(reason.isNotNull(), "broken").otherwise("verified")
    return rows.select("cite_id", status.alias("status"), reason.alias("reason"))
