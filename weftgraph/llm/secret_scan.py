"""Secrets: patterns that stand for themselves, and weak parts of credentials that count only together.  DataFrame functions only.

*Base spans* are leftmost, not overlapping within a kind, and checked afterwards; a match that fails is dropped without retry:
``assign`` (a secret's name and a value of 12 signs or more), ``access`` (access key identifiers of 18 or more), ``hex``
(runs of 16 or more).  Runs of one class are found from their first sign, so what is shorter costs no retry.

*Weak parts* are common in clean texts: ``short`` (a secret's name with a value of 6 to 11 signs), ``id`` (an account's or
client's name and value), ``key`` (a run of 20 or more with small and capital letters and digits), ``endpoint`` (an
address with a scheme, or a host's name and value).  Each part has a role: identifier (access, id), secret (assign, hex, short, key)
or endpoint.  The scope of a part is what lies at most ``reach`` code points before or behind it.  A weak identifier
is reported if a secret lies in its scope, a weak secret if an identifier does, an endpoint if both do.  Parts that overlap the
candidate are no partners, and a candidate that overlaps a part of an earlier kind is not reported.

Parts meet by an interval join: scopes and parts are dealt to bins of ``reach`` code points of their text, so keys are (row, bin)
and each holds a bounded number of parts however long a text is; of a candidate's partners of a role the nearest is kept.

Offsets are code points, ends exclusive.  Null text counts as empty; each row stands for itself, whether ids are null or
repeated; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .native_spans import SPAN, listed, matches, no_spans

KINDS = ["assign", "access", "hex", "short", "id", "key", "endpoint"]
BASE = 3
#: The patterns of the kinds; "short" is what "assign" drops.
_NAMED = r"""["']?+\x20*+[:=]\x20*+["']?+"""
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)" + _NAMED + r"([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    "id": r"(?<![A-Za-z0-9_])(?i:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)" + _NAMED + r"[A-Za-z0-9._@+-]{3,}+",
    "key": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "endpoint": r"(?<![A-Za-z0-9+.-])(?:(?:https?|ftp|ssh|amqps?|redis|postgres(?:ql)?|mysql|mongodb)://[^\x00-\x20\"'<>]{4,}+|(?i:host|endpoint|server)" + _NAMED + r"[A-Za-z0-9.-]{4,}+(?::[0-9]{1,5})?)",
}
#: What a text must hold for a kind to occur at all: cheaper than the pattern.
_HINTS = {
    "assign": lambda t: t.rlike(r"(?i)(?:passw|secret|token|api_?key)[a-z]*+[\"']?+\x20*+[:=]"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(PATTERNS["hex"]),
    "id": lambda t: t.rlike(r"(?i:user|name|login|account|id|access_?key)[\"']?+\x20*+[:=]"),
    "endpoint": lambda t: t.contains("://") | t.rlike(r"(?i:host|endpoint|server)[\"']?+\x20*+[:=]"),
}
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
ROLES = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "short": SECRET, "id": IDENTIFIER, "key": SECRET, "endpoint": ENDPOINT}
NEEDS = {"short": [IDENTIFIER], "id": [SECRET], "key": [IDENTIFIER], "endpoint": [IDENTIFIER, SECRET]}


def _spans(place: Column, kind: str) -> Column:
    return F.transform(place, lambda p: F.struct(F.lit(KINDS.index(kind)).alias("kind"), p["start"].alias("start"), p["end"].alias("end"))).cast(SPAN)


def _found(text: Column, kind: str) -> Column:
    return _spans(matches(text, PATTERNS[kind])[1], kind)


def _assigned(text: Column, kind: str, least: int, most: int | None) -> Column:
    """Matches of "assign" whose value has ``least`` to ``most`` signs."""
    size = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["assign"]), F.lit(1)), F.length)
    both = F.arrays_zip(_spans(matches(text, PATTERNS["assign"])[1], kind).alias("s"), size.alias("n"))
    fits = (lambda x: x["n"] >= least) if most is None else (lambda x: x["n"].between(least, most))
    return F.transform(F.filter(both, fits), lambda x: x["s"])


def _keys(text: Column) -> Column:
    found, place = matches(text, PATTERNS["key"])
    both = F.arrays_zip(found.alias("m"), _spans(place, "key").alias("s"))
    return F.transform(F.filter(both, lambda x: x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[0-9]")), lambda x: x["s"])


def _if(hint: Column, spans: Column) -> Column:
    return F.when(hint, spans).otherwise(no_spans())


def base_spans(text: Column) -> Column:
    """By kind, then start."""
    return F.concat(_if(_HINTS["assign"](text), _assigned(text, "assign", 12, None)), _if(_HINTS["access"](text), _found(text, "access")), _if(_HINTS["hex"](text), _found(text, "hex")))


def weak_parts(text: Column) -> Column:
    """Every candidate is an identifier or needs one, so texts without any have none."""
    some = _HINTS["access"](text) | _HINTS["id"](text)
    each = [_if(_HINTS["assign"](text), _assigned(text, "short", 6, 11)), _if(_HINTS["id"](text), _found(text, "id")), _keys(text), _if(_HINTS["endpoint"](text), _found(text, "endpoint"))]
    return _if(some, F.concat(*each))


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), kind + 1)


def link_parts(rows: DataFrame, reach: int) -> DataFrame:
    """(row, kind, start, end, links) of the weak parts that are reported; links are the nearest partner of each role as (role, kind, start, end).  ``rows`` has row, base and weak."""
    with_weak = rows.where(F.size("weak") > 0)
    parts = with_weak.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor((b - 1) / reach)))
    ours = with_weak.select("row", F.explode("weak").alias("c")).select("row", "c.*")
    ours = ours.select("row", *[F.col(c).alias(f"c_{c}") for c in ("kind", "start", "end")], bins(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach).alias("bin"))
    theirs = parts.select("row", "kind", "start", "end", _role(F.col("kind")).alias("role"), bins(F.col("start"), F.col("end")).alias("bin"))
    overlap = (F.col("start") < F.col("c_end")) & (F.col("c_start") < F.col("end"))
    gap = F.greatest(F.col("start") - F.col("c_end"), F.col("c_start") - F.col("end"), F.lit(0))
    met = ours.join(theirs, ["row", "bin"]).where((gap <= reach) & (~overlap | (F.col("kind") < F.col("c_kind"))))
    key = ["row", "c_kind", "c_start", "c_end"]
    nearest = met.groupBy(*key, "role").agg(F.max(overlap).alias("covered"), F.min(F.when(~overlap, F.struct(gap.alias("gap"), "start", "kind", "end"))).alias("p"))
    partner = F.when(F.col("p").isNotNull(), F.struct("role", F.col("p.kind").alias("kind"), F.col("p.start").alias("start"), F.col("p.end").alias("end")))
    each = nearest.groupBy(*key).agg(F.max("covered").alias("covered"), F.array_sort(F.collect_list(partner)).alias("links"))
    has = lambda role: F.exists("links", lambda x: x["role"] == role)
    enough = F.lit(False)
    for kind, roles in NEEDS.items():
        every = F.lit(True)
        for role in roles:
            every = every & has(role)
        enough = enough | ((F.col("c_kind") == KINDS.index(kind)) & every)
    return each.where(~F.col("covered") & enough).select("row", *[F.col(f"c_{c}").alias(c) for c in ("kind", "start", "end")], "links")


def _by_start(spans: Column) -> Column:
    """Ordered by start, then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, base and spans (all of them) by start, and linked: of each reported weak part the (kind, start, end, links)."""
    text = F.col("text")
    rows = shared.texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", base_spans(text).alias("base"), weak_parts(text).alias("weak"))
    rows = shared.table(rows, "secret-parts")
    linked = link_parts(rows, reach).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "links"))).alias("linked"))
    out = rows.join(linked, "row", "left")
    added = F.coalesce(F.transform("linked", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPAN), no_spans())
    return out.select("doc_id", _by_start(F.col("base")).alias("base"), _by_start(F.concat("base", added)).alias("spans"), "linked")


def secret_spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) and n_linked of every row."""
    out = find_secrets(docs, reach)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[count(k) for k in range(BASE)], F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_linked"))
