"""Scalars of names and dates, and their registration as functions of SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scope_chain(qualified: Column, name: Column) -> Column:
    """A definition's own scope chain, without the file before ::; the name where there is none."""
    q = F.coalesce(qualified, name, F.lit(""))
    return F.when(q.contains("::"), F.substring(q, F.locate("::", q) + 2, 1 << 30)).otherwise(q)


def scoped_name(qualified: Column, name: Column) -> Column:
    """The name with its scope where the recorded one ends in it."""
    tail = F.trim(F.element_at(F.split(F.coalesce(qualified, F.lit("")), "::"), -1))
    return F.when((tail != "") & (tail != name) & tail.endswith(name), tail).otherwise(name)


def utc_day(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd")


def age_days(newest: Column, ts: Column) -> Column:
    """Days from an instant to the newest one, none below zero."""
    return F.greatest((F.unix_micros(newest.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6 / 86400, F.lit(0.0))


def decay(days: Column, half_life: int = 180) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def iso_instant(text: Column) -> Column:
    """An instant from ISO text, from seconds or from milliseconds since 1970; null where it is none of them."""
    digits = text.rlike(r"^[0-9]+$")
    n = F.when(digits & (F.length(text) <= 16), text).cast("long")
    return F.when(digits, F.timestamp_millis(F.when(F.length(text) >= 12, n).otherwise(n * 1000))).otherwise(F.try_to_timestamp(text))


def register(spark: SparkSession) -> list[str]:
    """Makes the engine's scalars callable from SQL: weft_path, weft_topic, weft_id, weft_chunks (a table function)."""
    from pyspark.sql.functions import udtf

    from .chunk import split_document

    @udtf(returnType="chunk_ix int, chunk string")
    class Chunks:
        def eval(self, text: str, most: int, overlap: int):
            for i, c in enumerate(split_document(text or "", most, overlap)):
                yield i, c

    spark.udtf.register("weft_chunks", Chunks)
    path = r"concat('/', array_join(transform(filter(split(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', ''), '/'), s -> s <> ''), s -> if(s rlike '^[{:$]|[$][{]|^[0-9]+$|^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{16,}$', '{}', s)), '/'))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION weft_path(url STRING) RETURNS STRING RETURN {path}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weft_topic(topic STRING) RETURNS STRING RETURN lower(substring_index(substring_index(topic, ':', -1), '/', -1))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weft_id(name STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_'), '^_+|_+$', '')")
    return ["weft_chunks", "weft_path", "weft_topic", "weft_id"]
