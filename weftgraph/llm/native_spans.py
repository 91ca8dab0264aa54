"""Places of pattern matches as DataFrame functions, in time about linear in the number of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,start:int,end:int>>"
_PAIR = "array<struct<gap:int,n:int>>"
_BLOCK = 64


def no_spans() -> Column:
    return F.array().cast(SPAN)


def _total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0), lambda s, p: s + p["gap"] + p["n"])


def places(pairs: Column) -> Column:
    """(start, end) of matches from the (gap, n) before and of each.  Sums run within blocks of 64, then over the blocks, so an
    array of sums is rebuilt once for each block only."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"), F.lit(0))), lambda i: F.slice(pairs, i * _BLOCK + 1, _BLOCK))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, b: F.struct((acc["at"] + _total(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    before = F.aggregate(blocks, begun, step, lambda acc: acc["out"])

    def within(b: Column, base: Column) -> Column:
        def place(p: Column, j: Column) -> Column:
            start = base + _total(F.slice(b, 1, j)) + p["gap"]
            return F.struct(start.alias("start"), (start + p["n"]).alias("end"))

        return F.transform(b, place)

    return F.flatten(F.zip_with(blocks, before, within))


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of ``pattern`` (never empty) and, in the same order, their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"))).cast(_PAIR)
    return found, places(pairs)


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
