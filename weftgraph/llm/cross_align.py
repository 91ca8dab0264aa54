"""Alignment of two tokenizers' ids over the same bytes, by bitsets of token ends.

Both vocabularies give each token the bytes it stands for, so the tokens of a text end at byte offsets.  A packed bitset over
the bytes marks the ends of A's tokens, another those of B's; their AND holds the shared cuts.  Population counts, summed
before each word, give the rank of a cut in either bitset, which is the number of tokens up to it: so a cut maps to a range
of A's tokens and one of B's, the groups.  A group's last tokens end together and are linked; ``expand`` turns groups into links.

Cutting a text at single blanks between signs that are not white space changes neither tokenizer's ids (no vocabulary entry
of B goes on behind such a place, which is checked when it is loaded), and each such place is a shared cut.  So distinct
stretches are tokenized and aligned once for as long as a worker remembers them; a text is put together from its stretches.

The counts of linked id pairs over the corpus are aggregates of per-task sums.  Texts then look up the pairs counted most
often (``top``, a fixed number, so that what is broadcast has a bound) and meet the others in a join; a pair outside these
has at most 1/``top`` of all links, so no key of that join is hot.

Null and empty texts, and texts whose tokens' bytes are not blank + text in either vocabulary (those with the sign that
stands for a blank in B), have no tokens.  Each row stands for itself, whether ids are null or repeated; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordcache import _GAP, _UNEVEN_ARROW

#: Fixed value: the sign by which B writes a blank.
BLANK = "▁"


def byte_level_alphabet() -> dict[str, int]:
    """The sign by which byte-level vocabularies write each byte: itself if it prints in Latin-1, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One vocabulary: ids of stretches that begin with a blank, and the bytes of each id."""

    def __init__(self, encode, bytes_of: list[bytes]):
        self.encode, self.bytes_of = encode, np.array(bytes_of, dtype=object)
        self.sizes = np.array([len(x) for x in bytes_of], np.int64)
        self.names = pa.array([str(i) for i in range(len(bytes_of))], pa.string())

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids])


def byte_level(path: str) -> Side:
    """A ``tokenizers`` file of the byte-level kind; special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok, alphabet = Tokenizer.from_file(path), byte_level_alphabet()
    tok.encode_special_tokens = True
    pre, model = tok.pre_tokenizer, tok.model

    def encode(stretches: list[str]) -> list[list[int]]:
        return [[t.id for piece, _ in pre.pre_tokenize_str(x) for t in model.tokenize(piece)] if len(x) < 2000 else tok.encode(x, add_special_tokens=False).ids for x in stretches]

    names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    return Side(encode, [bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names])


def pieces(path: str) -> Side:
    """A ``sentencepiece`` model, which adds the blank before a text itself."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{BLANK}]{BLANK}", x) for x in names):
        raise ValueError("an entry of this vocabulary goes on behind a blank, so texts cannot be cut there")
    return Side(lambda stretches: sp.encode([x[1:] for x in stretches], num_threads=1), [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)])


def bitset(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """Packed 64-bit words with the bit of each token's last byte set."""
    bits = np.zeros(-(-n_bytes // 64) * 64, bool)
    bits[ends - 1] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def ranks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each of the bits ``at``."""
    before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
    up_to = ~np.uint64(0) >> (np.uint64(63) - (at.astype(np.uint64) & np.uint64(63)))
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & up_to).astype(np.int64)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which tokens of both end, and the number of A's and of B's tokens up to each."""
    a, b = bitset(ends_a, n_bytes), bitset(ends_b, n_bytes)
    at = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return at + 1, ranks(a, at), ranks(b, at)


def expand(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> np.ndarray:
    """The linked id pairs of the groups as (A id) << 32 | (B id): the tokens that end at the same byte are the last of each group's ranges."""
    return ids_a[upto_a - 1].astype(np.uint64) << np.uint64(32) | ids_b[upto_b - 1].astype(np.uint64)


_COLUMNS = ("n_a", "n_b", "groups", "links", "cuts")


class Aligner:
    """Aligned stretches of a worker process; at most ``entries`` of up to ``longest`` signs are remembered."""

    def __init__(self, a: Side, b: Side, entries: int = 400_000, longest: int = 40, with_cuts: bool = False):
        self.a, self.b, self.with_cuts = a, b, with_cuts
        self._known: dict[str, tuple | None] = {}
        self._entries, self._longest = entries, longest

    def align(self, stretches: list[str]) -> list[tuple | None]:
        """n_a, n_b, groups (text), links (bytes), cuts (bytes) of each stretch with its blank; None where the tokens' bytes are not the stretch's."""
        raw = [x.encode() for x in stretches]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sides, ok = [], np.ones(len(raw), bool)
        for side in (self.a, self.b):
            ids = side.encode(stretches)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))
            if side.joined(flat) != b"".join(raw) or (np.add.reduceat(np.append(side.sizes[flat], 0), np.append(0, np.cumsum(counts)[:-1])) != size).any():
                ok &= np.fromiter((side.joined(np.array(x, np.int64)) == r for x, r in zip(ids, raw)), bool, len(raw))
            sides.append((ids, flat, counts))
        if not ok.all():
            good = iter(self.align([x for x, k in zip(stretches, ok) if k]) if ok.any() else [])
            return [next(good) if k else None for k in ok.tolist()]
        (_, flat_a, n_a), (_, flat_b, n_b) = sides
        last = np.cumsum(size)
        cuts, upto_a, upto_b = shared_cuts(np.cumsum(self.a.sizes[flat_a]), np.cumsum(self.b.sizes[flat_b]), int(last[-1]))
        until = np.searchsorted(cuts, last, "right")
        text = pc.binary_join_element_wise(_joined(self.a.names, flat_a, upto_a), _joined(self.b.names, flat_b, upto_b), "|")
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, until), pa.int32()), text), ";").to_pylist()
        links = memoryview(expand(flat_a, flat_b, upto_a, upto_b).tobytes())
        inner = memoryview((cuts - np.repeat(last - size, np.diff(np.append(0, until)))).astype("<i8").tobytes())
        begin = np.append(0, until[:-1]).tolist()
        return [(na, nb, g, bytes(links[8 * i : 8 * j]), bytes(inner[8 * i : 8 * j]) if self.with_cuts else b"") for na, nb, g, i, j in zip(n_a.tolist(), n_b.tolist(), groups, begin, until.tolist())]

    def known(self, stretches: list[str]) -> list[tuple | None]:
        """The same from what is remembered; all that is missing is aligned at once."""
        get = self._known.get
        out = [get(x, 0) for x in stretches]
        missing = [k for k, x in enumerate(out) if x == 0]
        for i in range(0, len(missing), 50_000):
            part = missing[i : i + 50_000]
            new = [stretches[k] for k in part]
            for k, x, got in zip(part, new, self.align(new)):
                out[k] = got
                if len(x) <= self._longest and len(self._known) < self._entries:
                    self._known[x] = got
        return out

    def texts(self, column: pa.Array) -> dict[str, list]:
        """_COLUMNS of each text of a column without nulls; n_a is 0 for those without tokens."""
        n = len(column)
        out = {k: [None] * n for k in _COLUMNS}
        uneven = np.asarray(pc.match_substring_regex(column, _UNEVEN_ARROW))
        for rows, split in ((np.flatnonzero(~uneven), lambda x: pc.split_pattern(x, " ")), (np.flatnonzero(uneven), lambda x: pa.array([_GAP.split(t) for t in x.to_pylist()], pa.list_(pa.string())))):
            if len(rows):
                self._texts(column.take(pa.array(rows)), split, rows, out)
        for k in np.flatnonzero(np.asarray(pc.equal(column, ""))):
            for c in _COLUMNS:
                out[c][k] = 0 if c in ("n_a", "n_b") else "" if c == "groups" else b""
        return out

    def _texts(self, column: pa.Array, split, rows: np.ndarray, out: dict[str, list]) -> None:
        parts = split(column)
        coded = parts.flatten().dictionary_encode()
        got = self.known([" " + x for x in coded.dictionary.to_pylist()])
        bad = np.fromiter((x is None for x in got), bool, len(got))
        n_a, n_b, groups, links, cuts = zip(*(x or (0, 0, "", b"", b"") for x in got))
        number, at = coded.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy()))
        sums = lambda x: np.diff(np.append(0, np.cumsum(np.array(x, np.int64)[number]))[at])
        words = pa.array(groups, pa.string()).take(coded.indices)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), ";").to_pylist()
        flat = memoryview(pa.array(links, pa.binary()).take(coded.indices).buffers()[2] or b"")
        ends = (8 * np.append(0, np.cumsum(np.array([len(x) // 8 for x in links], np.int64)[number]))[at]).tolist()
        whole = sums(bad) > 0
        for k, row, na, nb, g, i, j in zip(range(len(rows)), rows.tolist(), sums(n_a).tolist(), sums(n_b).tolist(), texts, ends, ends[1:]):
            out["n_a"][row], out["n_b"][row], out["groups"][row], out["links"][row], out["cuts"][row] = na, nb, g, bytes(flat[i:j]), b""
        if self.with_cuts:
            for k, row in enumerate(rows.tolist()):
                before, own = 0, []
                for w in number[at[k] : at[k + 1]].tolist():
                    inner = np.frombuffer(cuts[w], "<i8")
                    own.append(inner + before)
                    before += int(inner[-1]) if len(inner) else 0
                out["cuts"][row] = np.concatenate(own).tobytes() if own else b""
        for k in np.flatnonzero(whole):  # bytes that do not match in a part may still match in the whole
            got = self.align([" " + column[int(k)].as_py()])[0] or (0, 0, "", b"", b"")
            for c, v in zip(_COLUMNS, got):
                out[c][rows[k]] = v


def _joined(names: pa.Array, flat: np.ndarray, upto: np.ndarray) -> pa.Array:
    """The ids of each group, comma-joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), names.take(pa.array(flat))), ",")


def aligner(path_a: str, path_b: str, with_cuts: bool) -> Aligner:
    """One for each worker process."""
    made, key = shared.kept("align"), (path_a, path_b, with_cuts)
    if key not in made:
        made[key] = Aligner(byte_level(path_a), pieces(path_b), with_cuts=with_cuts)
    return made[key]


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_cuts: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;...``), cuts (on request: the byte offsets, in blank + text, at which groups end), pairs and times: the distinct linked id pairs of the
    row, ascending, as little-endian (A id << 32 | B id), and how often each is linked there, as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b, with_cuts)
        for batch in shared.slices(batches, owner="align"):
            got = made.texts(batch.column("text"))
            sizes = np.fromiter((len(x) // 8 for x in got["links"]), np.int64, batch.num_rows)
            flat = np.frombuffer(b"".join(got["links"]), "<u8")
            order = np.lexsort((flat, np.repeat(np.arange(batch.num_rows), sizes)))
            row, flat = np.repeat(np.arange(batch.num_rows), sizes), flat[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(flat))).astype("<u4")
            at = np.searchsorted(row[first], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(got["n_a"], pa.int64()),
                    pa.array(got["n_b"], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(got["groups"], pa.string()),
                    pa.array([np.frombuffer(x, "<i8") for x in got["cuts"]] if with_cuts else [None] * batch.num_rows, pa.list_(pa.int64())),
                    _slices(flat[first], 8, at),
                    _slices(times, 4, at),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups", "cuts", "pairs", "times"],
            )

    return shared.texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups string, cuts array<long>, pairs binary, times binary")


def _slices(values: np.ndarray, width: int, at: np.ndarray) -> pa.Array:
    """Binary values that are consecutive ranges of an array, without copying each."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs, times and row numbers of a batch."""
    pairs = [np.frombuffer(x, "<u8") for x in batch.column("pairs").to_pylist()]
    times = [np.frombuffer(x, "<u4") for x in batch.column("times").to_pylist()]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *pairs]), np.concatenate([empty, *times]).astype(np.int64), np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])


def pair_counts(aligned: DataFrame, most: int = 2_000_000) -> DataFrame:
    """pair, n (its links over all rows), best (whether no other pair of its B id has more).  A task sums up about ``most`` entries before it sends them on."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            pairs, inverse = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)  # exact: far under 2**53
            held[:] = [(pairs, n)]
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in shared.slices(batches, column="pairs", owner="align"):
            pairs, times, _ = _flat(batch)
            if len(pairs):
                held.append((pairs, times))
            if sum(len(p) for p, _ in held) > most:
                out = flush()
                if out.num_rows > most // 2:
                    yield out
                    held.clear()
        if held:
            yield flush()

    counts = aligned.select("pairs", "times").mapInArrow(sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = shared.table(counts.withColumn("b", F.expr("pair & 4294967295")), "pair-counts")
    # One row for each id of B's vocabulary at most, whatever the corpus.
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, top: int = 65_536) -> DataFrame:
    """``aligned`` without pairs and times, with n_best (links whose pair has its B id's highest count) and count_sum (the sum of the links' counts)."""
    spark = aligned.sparkSession
    rows = shared.table(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = shared.table(pair_counts(rows), "scored-pairs")
    first = counts.orderBy(F.desc("n"), "pair").limit(top).toArrow()  # at most ``top`` rows
    order = np.argsort(first.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(first.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("pair", "n", "best")))
    keep = [f for f in rows.schema if f.name not in ("pairs", "times")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in shared.slices(batches, column="pairs", owner="align"):
            pairs, times, row = _flat(batch)
            at = np.minimum(np.searchsorted(pair, pairs.astype(np.int64)), max(len(pair) - 1, 0))
            hit = pair[at] == pairs.astype(np.int64) if len(pair) else np.zeros(len(pairs), bool)
            at, own, k = at[hit], row[hit], times[hit]
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, own, n[at] * k)
            np.add.at(bests, own, best[at] * k)
            rest = np.searchsorted(row[~hit], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit].astype(np.int64))) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(bests), pa.array(sums), *lists], names=[*(f.name for f in keep), "n_best", "count_sum", "rest", "rest_times"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    part = shared.table(rows.mapInArrow(look, kinds + ", n_best long, count_sum long, rest array<long>, rest_times array<long>"), "looked-up")
    shared.drop_table(rows)
    others = part.select("_row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("_row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    met = others.join(counts.hint("merge"), "pair").groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("t"))
    out = part.join(met, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(*[f.name for f in keep if f.name != "_row"], (F.col("n_best") + zero("t")).alias("n_best"), (F.col("count_sum") + zero("s")).alias("count_sum"))
