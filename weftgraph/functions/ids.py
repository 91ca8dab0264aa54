"""Identifiers: stable, readable keys for joins."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(x: str) -> str:
    """NFKC, case-folded, other signs as single underscores; idempotent."""
    before = None
    while x != before:
        before, x = x, unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold())
    return re.sub(r"[\W_]+", "_", x).strip("_")


def normalize_id(x: Column) -> Column:
    """The ASCII form of ``normalize_text`` without Python: exact where all letters are ASCII."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def make_id(*parts: Column) -> Column:
    return normalize_id(F.concat_ws("_", *parts))


def symbol_id(slug: Column, *parts: Column, digits: int = 8) -> Column:
    """The slug and the first hex digits of the parts' digest; a null part counts as empty.  Eight tell some tens of thousands of symbols of one slug apart, 32 any number."""
    joined = F.concat_ws("\u0000", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(slug, F.lit("_"), F.substring(F.sha2(joined, 256), 1, digits))


def symbol_id_of(slug: str, *parts: str | None, digits: int = 8) -> str:
    return f"{slug}_{hashlib.sha256(chr(0).join(p or '' for p in parts).encode()).hexdigest()[:digits]}"


def remote_key(url: Column) -> Column:
    """host/path of a remote: no user, scheme or .git, lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^@/]*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^([^/:]+):(?:[0-9]+/)?", "$1/"), r"(\.git)?/*$", ""))
