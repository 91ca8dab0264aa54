"""Which texts hold which names as whole words: ``\\bname\\b`` for names of any length and any signs.

A name of word signs alone is a whole word exactly where it equals a run of them, so such names meet texts by a join.  All others
go through Aho-Corasick automatons over parts of the name table, each of a bounded number of names; texts are streamed past them, in linear time, and both ends of
what is found are held to be word boundaries.  Word signs are letters, numbers and the underscore of any script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton.
PART = 100_000
WORD = r"([\p{L}\p{N}_]+)"


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def whole(text: str, start: int, end: int) -> bool:
    """Whether both ends of a stretch are word boundaries."""
    return _is_word(text, start - 1) != _is_word(text, start) and _is_word(text, end - 1) != _is_word(text, end)


def _scan(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for name in names:
            found.add_word(name, name)
        found.make_automaton()
        for batch in batches:
            rows, own = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for name in {name for end, name in found.iter(text or "") if whole(text, end + 1 - len(name), end + 1)}:
                    rows.append(k)
                    own.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(own, pa.string())], names=["doc_id", "name"])

    return run


def names_in(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name), once each, of the ``names`` (name) that the texts (doc_id, text) hold."""
    known = names.select("name").where(F.length("name") > 0).distinct()
    plain = F.col("name").rlike(r"^[\p{L}\p{N}_]+$")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))).alias("name"))
    out = [words.join(known.where(plain), "name").select("doc_id", "name").distinct()]
    others = known.where(~plain)
    n = -(-others.count() // PART)
    kind = docs.schema["doc_id"].dataType.simpleString()
    for part in range(n):
        # About PART names each: what an automaton holds is bounded, and the number of parts grows with the table.
        most = 2 * PART + 100
        own = [r["name"] for r in others.where(F.pmod(F.xxhash64("name"), F.lit(n)) == part).limit(most).collect()]
        if len(own) == most:
            raise ValueError("a part of the name table is too large; raise the number of parts")
        out.append(docs.select("doc_id", "text").mapInArrow(_scan(own), f"doc_id {kind}, name string").distinct())
    return reduce(DataFrame.unionByName, out)
