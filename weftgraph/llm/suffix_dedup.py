"""Exact removal of repeated byte strings with a difference-cover suffix sort, one bucket of suffixes at a time.

A byte is removed if a string of ``span`` bytes that covers it also starts in a document with a smaller doc_id.

1. *Buckets.*  Every string of ``span`` bytes holds an anchor: the smallest hash among its ``gram``-byte substrings, which
   depends on the string alone.  Texts send the hashes of their anchors, once each; sorted by (anchor, document) they
   are streamed, and only anchors that several documents share go on.  So suffixes that cannot repeat are never sorted.
2. *Slots.*  A text sends, for each shared anchor, its distinct contexts: the bytes around the anchor that strings holding it can
   reach.  A context fills a slot of fixed length with the anchor at a fixed place, so a string that starts r bytes into its slot
   has the same residue as any string equal to it.
3. *Suffix sort.*  Slots of one bucket (a run of whole anchors, at most ``chunk`` slots) form the text whose suffixes are sorted.
   Ranks of the suffixes at difference-cover positions (cover {0, 1, 3} modulo 7) are computed first, from right to
   left: the bytes up to the next cover position, then its rank.  Every other suffix reaches a cover position within few
   bytes, so it is sorted by those bytes and the rank found there: long ties cost nothing, and memory is that of one bucket.
   Neighbours in suffix order that agree in ``span`` bytes form a group; all but those of its smallest document are marked.
   A longer anchor group is continued with those of its slots that held a string first.  An anchor of very many documents is dealt in halves:
   strings that start early enough in their slot go by the anchor and 13 bytes before it, the others by the anchor and 13 bytes behind it.
4. *Cut.*  Marks return to their documents, whose covered bytes are cut out.

Null text counts as empty.  Rows with a null doc_id neither remove nor lose anything (no document is smaller than they, they
are smaller than none).  Rows with one doc_id do not affect each other.  Texts shorter than ``span`` bytes stay.  An
empty table gives no rows; other columns are kept by ``drop_repeats`` and ignored by ``find_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .hashing import mix, prefix_sums, range_hash, shared_keys

SPAN, GRAM = 50, 24
_REACH = SPAN - GRAM  # bytes on either side of an anchor that a string holding it can cover
_STARTS = _REACH + 1  # places in a slot at which such a string can start
#: The smallest difference cover modulo 7.
COVER, PERIOD = [0, 1, 3], 7
_SLOT = 2 * _REACH + GRAM
#: A string that holds an anchor holds this many bytes before it too (if it starts at most so far into its slot) or as many behind it.
_HALF = _REACH // 2
#: Documents beyond which an anchor's slots are dealt by a longer key.
_HOT = 100_000


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i where that fits."""
    reach = 1
    while reach * 2 <= width:
        x = op(x[:-reach], x[reach:])
        reach *= 2
    return op(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


class Anchored:
    """The anchors of several texts, computed over all their bytes at once: grams that are smallest within some string of SPAN bytes of their text.

    places (in data), hashes, doc (number of the text), and the bytes of the text on either side of each place, left and right, that its context holds.
    """

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        self.edges = edges = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        self.sums = prefix_sums(data)
        n = len(data) - SPAN + 1
        if n <= 0:
            self.places = self.doc = self.hashes = np.zeros(0, np.int64)
        else:
            at = np.arange(len(data) - GRAM + 1)
            h = range_hash(self.sums, at, at + GRAM)
            width = SPAN - GRAM + 1
            least = _slide(h, width, np.minimum)  # of the string that starts here
            # Strings that cross from one text to the next don't count.
            for e in edges[1:-1].tolist():
                least[max(0, e - SPAN + 1) : e] = 0
            most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
            self.places = np.flatnonzero((h == most) & (most != 0))
            self.hashes = h[self.places].astype(np.int64)
            self.doc = np.searchsorted(edges, self.places, side="right") - 1
        self._extents()

    def _extents(self) -> None:
        self.left = np.minimum(self.places - self.edges[self.doc], _REACH)
        self.right = np.minimum(self.edges[self.doc + 1] - self.places - GRAM, _REACH)

    def keep(self, which: np.ndarray) -> None:
        self.places, self.hashes, self.doc, self.left, self.right = (x[which] for x in (self.places, self.hashes, self.doc, self.left, self.right))

    def own(self, value: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Values told apart by their text."""
        return mix(value.astype(np.uint64) ^ mix(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))

    def idents(self) -> np.ndarray:
        return idents(self.sums, self.places, self.left, self.right)

    def slots(self) -> np.ndarray:
        """A slot for each place: the context, zeros outside the text, and the two extents."""
        padded = np.concatenate([np.zeros(_REACH, np.uint8), self.data, np.zeros(_REACH + GRAM, np.uint8)])
        slots = np.lib.stride_tricks.sliding_window_view(padded, _SLOT)[self.places]
        column = np.arange(_SLOT)
        inside = (column >= (_REACH - self.left)[:, None]) & (column < (_REACH + GRAM + self.right)[:, None])
        return np.concatenate([slots * inside, np.stack([self.left, self.right], axis=1).astype(np.uint8)], axis=1)


def idents(sums: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each context's bytes and of where the anchor lies in them."""
    return mix(range_hash(sums, places - left, places + GRAM + right) + left.astype(np.uint64)).astype(np.int64)


def _words(slots: np.ndarray, at: int, n: int) -> np.ndarray:
    """The n (at most 8) bytes at ``at`` of each slot, as integers in byte order."""
    out = np.zeros(len(slots), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | (slots[:, at + k].astype(np.uint64) if at + k < slots.shape[1] else np.uint64(0))
    return out


def _ranks(head: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks by head (at most four bytes), then rank (31 bits), and the order."""
    key = head if rank is None else head << np.uint64(31) | rank.astype(np.uint64)
    order = np.argsort(key)
    new = np.append(False, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, order


def sort_bucket(slots: np.ndarray, docs: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each slot, bit r set if the string that starts at r also starts in a slot with a smaller doc.

    ``slots`` is one bucket: whole groups with equal anchors, so equal strings start at equal places of their slots.
    """
    n = len(slots)
    cover = [p for p in range(_SLOT) if p % PERIOD in COVER]
    rank: dict[int, np.ndarray] = {}
    following = _SLOT
    for p in reversed(cover):
        head = _words(slots, p, following - p)
        rank[p] = _ranks(head, rank.get(following))[0]
        following = p
    marks = np.zeros(n, np.int64)
    for r in range(_STARTS):
        own = np.flatnonzero((edges[:, 0] <= r) & (r < edges[:, 0] + edges[:, 1]))
        if len(own) < 2:
            continue
        to = next(p for p in cover if p >= r)
        # A suffix's last bytes may lie outside the text, so neighbours are compared over the span.
        order = own[_ranks(_words(slots, r, to - r)[own], rank[to][own])[1]]
        strings = np.ascontiguousarray(slots[order, r : r + SPAN])
        new = np.append(True, (strings[1:] != strings[:-1]).any(1))
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[order], starts)
        marks[order] |= (docs[order] > np.repeat(least, np.diff(np.append(starts, len(order))))).astype(np.int64) << r
    return marks


def _sort_stream(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Marks of slots that come sorted by (key, doc_id); a bucket is at most ``chunk`` slots and what a split group carries."""
    held: list[tuple] = []
    size = 0
    carry = None  # slots of a group that goes on, each the first to hold some string

    def run(parts: list[tuple], carried):
        key, doc, check, ident, slots, edges = (np.concatenate(x) for x in zip(*parts))
        if carried is not None:
            same = carried[0] == key[0]
            keys, docs, s, e = (np.concatenate([c[same], x]) for c, x in zip(carried, (key, doc, slots, edges)))
            extra = int(same.sum())
        else:
            keys, docs, s, e, extra = key, doc, slots, edges, 0
        marks = sort_bucket(s, docs, e)
        full = (((np.int64(1) << e[:, 1]) - 1) << e[:, 0]) & ~marks
        again = (keys == keys[-1]) & (full != 0)
        # Of equal contexts one is enough: the first, which has the smallest document.
        _, one = np.unique(np.concatenate([s[again], e[again].astype(np.uint8)], axis=1), axis=0, return_index=True) if again.any() else (None, np.zeros(0, np.int64))
        at = np.flatnonzero(again)[np.sort(one)]
        own = marks[extra:]
        hit = own != 0
        out = pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(check[hit]), pa.array(ident[hit]), pa.array(own[hit])], names=["doc_id", "check", "ident", "marks"])
        return out, (keys[at], docs[at], s[at], e[at])

    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column("slot").to_pylist()), np.uint8).reshape(batch.num_rows, _SLOT + 5)
        slots, (left, right) = raw[:, :_SLOT], raw[:, _SLOT : _SLOT + 2].astype(np.int64).T
        check, part = raw[:, _SLOT + 2].astype(np.int64) << 8 | raw[:, _SLOT + 3], raw[:, _SLOT + 4]
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        sums, at = prefix_sums(np.ascontiguousarray(slots).ravel()), np.arange(batch.num_rows) * _SLOT + _REACH
        key = mix(range_hash(sums, at - _HALF * (part == 1), at + GRAM + _HALF * (part == 2)) + part).astype(np.int64)
        # Where strings that hold the anchor can start, and how many places there are; a half of a hot anchor takes its own.
        low, high = _REACH - left, np.maximum(right + 1, _REACH - left)
        low, high = np.where(part == 2, np.maximum(low, _HALF + 1), low), np.where(part == 1, np.minimum(high, _HALF + 1), high)
        edges = np.stack([low, np.maximum(high - low, 0)], axis=1)
        held.append((key, doc, check, idents(sums, at, left, right), slots, edges))
        size += batch.num_rows
        if size >= chunk:
            out, carry = run(held, carry)
            yield out
            held, size = [], 0
    if held:
        yield run(held, carry)[0]


def _check(text: bytes) -> int:
    """Tells rows with one doc_id and different texts apart."""
    return xxhash.xxh3_64_intdigest(text) & 0xFFFF


def _raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def find_marks(docs: DataFrame, chunk: int = 1 << 16, hot: int = _HOT) -> DataFrame:
    """(doc_id, _marks): for each document with repeats, (check of the text, hash of a context, starts marked in it)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shared.texts(docs).where(F.col("doc_id").isNotNull())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, most=1 << 19):
            a = Anchored(_raw(batch))
            _, one = np.unique(a.own(a.hashes, a.doc), return_index=True)
            one.sort()
            ends = np.append(0, np.cumsum(np.bincount(a.doc[one], minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(a.hashes[one]))], names=["doc_id", "keys"])

    sent = rows.mapInArrow(send, "doc_id long, keys array<long>").select(F.explode("keys").alias("key"), "doc_id")
    ordered = sent.repartition(n, "key").sortWithinPartitions("key", "doc_id")
    found = shared.table(ordered.mapInArrow(lambda b: shared_keys(b, "doc_id"), "key long, first long, doc_id long"), "shared-anchors")

    # So many documents for each hot anchor that there are at most 50 of them a partition: the set is bounded by the cluster, not by the data.
    limit = max(hot, found.count() // (50 * n))
    hot_keys = np.array([r["key"] for r in found.groupBy("key").count().where(F.col("count") > limit).select("key").collect()], np.int64)
    wanted = found.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, most=1 << 19):
            texts, keys = _raw(batch), batch.column("keys")
            a = Anchored(texts)
            given = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            a.keep(np.isin(a.own(a.hashes, a.doc), a.own(keys.flatten().to_numpy(zero_copy_only=False), given)))
            _, one = np.unique(a.own(a.idents(), a.doc), return_index=True)
            a.keep(np.sort(one))
            check = np.array([divmod(_check(t), 256) for t in texts], np.uint8).reshape(-1, 2)
            both = np.concatenate([a.slots(), check[a.doc], np.zeros((len(a.doc), 1), np.uint8)], axis=1)
            doc = a.doc
            if len(hot_keys) and (split := np.isin(a.hashes, hot_keys)).any():
                halves = [both[split], both[split]]
                halves[0][:, -1], halves[1][:, -1] = 1, 2
                both, doc = np.concatenate([both[~split], *halves]), np.concatenate([doc[~split], doc[split], doc[split]])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_SLOT + 5), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), fixed], names=["doc_id", "slot"])

    # Written, so that the shuffle of the texts is gone before that of the slots begins.
    joined = shared.table(rows.join(wanted, "doc_id"), "anchored-texts")
    part = F.substring("slot", _SLOT + 5, 1)
    one, two = (F.lit(bytes([k])) for k in (1, 2))
    bytes_of = F.when(part == one, F.substring("slot", _REACH - _HALF + 1, GRAM + _HALF)).when(part == two, F.substring("slot", _REACH + 1, GRAM + _HALF)).otherwise(F.substring("slot", _REACH + 1, GRAM))
    anchor = F.concat(part, bytes_of) if len(hot_keys) else F.substring("slot", _REACH + 1, GRAM)
    bucketed = joined.mapInArrow(slots, "doc_id long, slot binary").repartition(n, anchor).sortWithinPartitions(anchor, "doc_id")
    marks = shared.table(bucketed.mapInArrow(lambda b: _sort_stream(b, chunk), "doc_id long, check long, ident long, marks long"), "marks")
    shared.drop_table(found)
    shared.drop_table(joined)
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("check", "ident", "marks")).alias("_marks"))


def _all_runs(texts: list[bytes], given: list[tuple | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the removed runs of each text, from its marks."""
    none = np.zeros(0, np.int64)
    out = [(none, none)] * len(texts)
    marked = []
    for i, (t, m) in enumerate(zip(texts, given)):
        if m is not None and (own := m[0] == _check(t)).any():
            marked.append((i, m[1][own], m[2][own]))
    if not marked:
        return out
    a = Anchored([texts[i] for i, _, _ in marked])
    number = np.repeat(np.arange(len(marked)), [len(x) for _, x, _ in marked])
    ident, marks = a.own(np.concatenate([x for _, x, _ in marked]), number), np.concatenate([x for _, _, x in marked])
    # A context's marks may come in two halves.
    ident, where = np.unique(ident, return_inverse=True)
    bits = np.zeros(len(ident), np.int64)
    np.bitwise_or.at(bits, where, marks)
    own = a.own(a.idents(), a.doc)
    at = np.minimum(np.searchsorted(ident, own), len(ident) - 1)
    hit = ident[at] == own
    places, bits = a.places[hit], bits[at[hit]]
    change = np.zeros(len(a.data) + 1, np.int32)
    for r in range(_STARTS):
        starts = places[(bits >> r) & 1 == 1] - _REACH + r
        change[starts] += 1  # places differ, so do the starts
        change[starts + SPAN] -= 1
    gone = np.cumsum(change[:-1]) > 0
    for k, (i, _, _) in enumerate(marked):
        g = np.concatenate([[False], gone[a.edges[k] : a.edges[k + 1]], [False]])
        cut = np.flatnonzero(g[1:] != g[:-1])
        out[i] = (cut[::2], cut[1::2])
    return out


def _with_marks(docs: DataFrame, marks: DataFrame, *keep: str) -> DataFrame:
    """Each row with the marks of its doc_id."""
    return shared.texts(docs, *keep).join(marks, "doc_id", "left")


def _marks_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """check, ident and marks of each row, as arrays."""
    column = batch.column("_marks")
    check, ident, marks = (column.values.field(k).to_numpy(zero_copy_only=False) for k in ("check", "ident", "marks"))
    for given, a, b in zip(column.is_valid().to_pylist(), column.offsets.to_pylist(), column.offsets.to_pylist()[1:]):
        yield (check[a:b], ident[a:b], marks[a:b]) if given else None


def _runs(text: bytes, marks: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the removed runs."""
    return _all_runs([text], [marks])[0]


def _rest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end byte) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, most=1 << 19):
            out, raw = [], _raw(batch)
            for doc_id, text, (a, b) in zip(batch.column("doc_id").to_pylist(), raw, _all_runs(raw, list(_marks_of(batch)))):
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
                out.append((doc_id, len(text), int((b - a).sum()), len(a), hashlib.sha256(_rest(text, a, b)).hexdigest(), spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return _with_marks(docs, find_marks(docs)).mapInArrow(work, schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed bytes cut out of text (bytes that no longer form a character at a cut are dropped too)."""
    names, kinds = docs.columns, dict(docs.dtypes)
    row = F.struct(*[F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]).alias("_row")
    rest = [c for c in names if c not in ("doc_id", "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, most=1 << 19):
            texts, raw = [], _raw(batch)
            for text, (a, b) in zip(raw, _all_runs(raw, list(_marks_of(batch)))):
                texts.append(_rest(text, a, b).decode("utf-8", "ignore") if len(a) else text.decode())
            columns = [batch.column("doc_id"), pa.array(texts, pa.string()), *([batch.column("_row")] if rest else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", *(["_row"] if rest else [])])

    keep = [row] if rest else []
    joined = _with_marks(docs, find_marks(docs), *keep)
    inner = ", ".join(f"`{c}`: {kinds[c]}" for c in rest)
    out = joined.mapInArrow(work, "doc_id long, text string" + (f", _row struct<{inner}>" if rest else ""))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in names])
