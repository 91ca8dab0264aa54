"""Byte-level BPE without regular expressions: class arrays, transition-function scans, cached pair merging.

All texts of a slice lie in one array of code points, separated by a sentinel.  A table gives the class of
each code point; class and neighbours give a symbol; each symbol is a transition function on eight states.
Functions compose associatively.  Most symbols are constant functions, which absorb everything before
them, so only runs of the others (an apostrophe that may open a contraction, and the letters it would take)
need composing; they are composed by doubling.  State and symbol say where a piece begins.  Slices of
the texts at these places go through rank-ordered pair merging, with a bounded cache.

Null text counts as empty and gives no ids; an empty table gives an empty result; repeated rows and ids give
a row each; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What an apostrophe takes at the start of a piece.
SHORT_ENDINGS = ["s", "t", "m", "d"]
LONG_ENDINGS = ["re", "ve", "ll"]

_END = 0x110000
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, END = range(7)
# Symbols: a letter, a number, another sign; white space inside a run; a blank that joins the next piece; other
# white space before something else; apostrophes with a short or long ending; a letter of such; the end of a text.
S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_JOIN, S_ALONE, S_SHORT, S_LONG, S_TAKEN, S_END = range(10)
# States: at a boundary; in a run of letters, numbers, others, white space; after a joining blank; one or two letters to take.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, JOINED, ONE_MORE, TWO_MORE = range(8)
_STATES = 8


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, and of the sentinel after the last."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(_END)), np.uint8, _END)
    out[WHITE_SPACE] = SPACE
    out[0x20], out[0x27] = BLANK, APOSTROPHE
    return np.append(out, np.uint8(END))


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state; the value of constant functions, else 255."""
    nxt, begins = np.zeros((10, _STATES), np.uint8), np.ones((10, _STATES), bool)
    for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        nxt[symbol] = run
        begins[symbol, [run, JOINED]] = False
    nxt[S_INNER], begins[S_INNER, IN_SPACE] = IN_SPACE, False
    nxt[S_JOIN], nxt[S_ALONE], nxt[S_END] = JOINED, FRESH, FRESH
    for symbol, more in ((S_SHORT, ONE_MORE), (S_LONG, TWO_MORE)):
        nxt[symbol] = more
        nxt[symbol, [IN_OTHERS, JOINED]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, JOINED]] = False
    nxt[S_TAKEN], begins[S_TAKEN] = nxt[S_LETTER], begins[S_LETTER]
    nxt[S_TAKEN, [ONE_MORE, TWO_MORE]], begins[S_TAKEN, [ONE_MORE, TWO_MORE]] = [FRESH, ONE_MORE], False
    constant = np.where((nxt == nxt[:, :1]).all(1), nxt[:, 0], 255).astype(np.uint8)
    return nxt, begins, constant


def symbols(points: np.ndarray) -> np.ndarray:
    cls = classes()[points]
    after = np.append(cls[1:], np.uint8(END))
    out = cls.copy()  # letters, numbers and others have the numbers of their classes
    space = (cls == SPACE) | (cls == BLANK)
    inner = space & ((after == SPACE) | (after == BLANK) | (after == END))
    out[space] = S_ALONE
    out[cls == BLANK] = S_JOIN
    out[inner] = S_INNER
    out[cls == END] = S_END
    at = np.flatnonzero(cls == APOSTROPHE)
    out[at] = S_OTHER
    if len(at):
        padded = np.append(points, [_END, _END])
        one, two = padded[at + 1], padded[at + 2]
        short = at[np.isin(one, [ord(x) for x in SHORT_ENDINGS])]
        long = at[np.any([(one == ord(x[0])) & (two == ord(x[1])) for x in LONG_ENDINGS], axis=0)]
        out[short], out[short + 1] = S_SHORT, S_TAKEN
        out[long], out[long + 1], out[long + 2] = S_LONG, S_TAKEN, S_TAKEN
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that are each closed by the sentinel; the sentinels are among them."""
    nxt, begins, constant = automaton()
    sym = symbols(points)
    state = constant[sym]
    at = np.flatnonzero(state == 255)
    if len(at):
        f = nxt[sym[at]]
        heads = np.append(True, np.diff(at) != 1)
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
        reach, longest = 1, int(place.max()) + 1
        while reach < longest:
            to = np.flatnonzero(place >= reach)
            f[to] = np.take_along_axis(f[to], f[to - reach].astype(np.intp), 1)
            reach *= 2
        before = at - place - 1
        state[at] = f[np.arange(len(at)), np.where(before >= 0, state[before], FRESH)]
    return np.flatnonzero(begins[sym, np.append(np.uint8(FRESH), state[:-1])])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank, leftmost first, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        rank = [ranks.get(parts[i] + parts[i + 1], _END) for i in range(n - 1)]
        while rank and (low := min(rank)) != _END:
            i = rank.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], _END)
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], _END)
        return [ranks[p] for p in parts]
    # Long pieces: a heap of pairs over a linked list, so the time grows with n log n.
    end, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    pair = lambda i: ranks.get(piece[i : end[right[i]]]) if right[i] < n else None
    now = [pair(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(now) if r is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or now[i] != r:
            continue
        j = right[i]
        end[i], right[i], alive[j] = end[j], right[j], 0
        if right[i] < n:
            left[right[i]] = i
        for k in (i, left[i]):
            if k >= 0:
                now[k] = pair(k)
                if now[k] is not None:
                    heapq.heappush(heap, (now[k], k))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class ByteBpe:
    """Vocabulary of a rank file; at most ``entries`` pieces of up to ``longest`` signs are remembered."""

    def __init__(self, path: str, entries: int = 600_000, longest: int = 48):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self._bytes = dict(zip(self.ranks.values(), self.ranks))
        self._cache, self._entries, self._longest = _Pieces(self), entries, longest

    def split(self, texts: list[str]) -> list[list[str]]:
        joined = [np.append(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.uint32(_END)) for t in texts]
        points = np.concatenate(joined) if joined else np.zeros(0, np.uint32)
        starts = piece_starts(points)
        edges = np.append(0, np.cumsum([len(x) for x in joined]))
        cuts = np.searchsorted(starts, edges)
        out = []
        for k, text in enumerate(texts):
            own = (starts[cuts[k] : cuts[k + 1]] - edges[k]).tolist()
            out.append([text[a:b] for a, b in zip(own, own[1:])])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        find = self._cache.__getitem__
        return [b"".join(map(find, pieces)) for pieces in self.split(texts)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id begins in its text, and the text's length."""
        return np.append(0, np.cumsum([len(self._bytes[i]) for i in ids.tolist()]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


class _Pieces(dict):
    def __init__(self, bpe: ByteBpe):
        self._bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self._bpe.ranks), "<u4").tobytes()
        if len(piece) <= self._bpe._longest and len(self) < self._bpe._entries:
            self[piece] = ids
        return ids


def vocabulary(path: str) -> ByteBpe:
    """One for each worker process."""
    made = shared.kept("bytes")
    if path not in made:
        made[path] = _vocabulary(path)
    return made[path]


def _vocabulary(path: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers) of each row's whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks)
        for batch in shared.slices(batches, most=1 << 20, owner="bytes"):
            ids = bpe.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return shared.texts(docs).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, with_offsets: bool = False) -> DataFrame:
    """Adds ``decoded`` (the bytes of the ids, in order) and, on request, ``offsets`` (where each id's bytes begin)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks)
        for batch in shared.slices(batches, column="ids", most=4 << 20, owner="bytes"):
            ids = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            columns = [*batch.columns, pa.array([bpe.decode(x) for x in ids], pa.binary())]
            if with_offsets:
                columns.append(pa.array([bpe.offsets(x)[:-1].tolist() for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded", *["offsets"] * with_offsets])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode, kinds + ", decoded binary" + ", offsets array<long>" * with_offsets)
