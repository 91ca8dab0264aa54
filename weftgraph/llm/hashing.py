"""Vectorised hashes of byte ranges, shingle sets of texts, and streaming over sorted (key, value) rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(16, int(n - 1).bit_length()))[:n]


#: A random-looking value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` takes the polynomial hash of any range."""
    return np.append(np.uint64(0), np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=np.uint64))


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end); equal bytes have equal hashes wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, behind each other, and where each text's begin (one more at the end).

    Words are runs without white space, A-Z lower-cased; a text with fewer words has its whole sequence as its only shingle.
    """
    data = np.frombuffer(b" ".join([*(t.lower() for t in texts), b""]), np.uint8)
    edges = np.append(0, np.cumsum([len(t) + 1 for t in texts])).astype(np.int64)
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    change = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    w = range_hash(prefix_sums(data), starts, ends)
    doc = np.searchsorted(edges, starts, side="right") - 1
    first = np.searchsorted(starts, edges)  # number of the first word of each text
    count = np.diff(first)
    h = np.zeros(len(w), np.uint64)
    left = first[doc + 1] - np.arange(len(w))  # words from here to the text's end
    for k in range(words):
        own = np.flatnonzero(left > k)
        h[own] += mix(w[own + k] ^ np.uint64(k + 1)) * np.uint64(2 * k + 3)
    h = mix(h ^ np.minimum(count[doc], words).astype(np.uint64))
    keep = (left >= words) | ((count[doc] < words) & (left == count[doc]))
    h, size = h[keep], np.bincount(doc[keep], minlength=len(texts))
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        h[a:b].sort()
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    new[ends[:-1][size > 0]] = True
    return h[new], np.append(0, np.cumsum(new, dtype=np.int64))[ends]


def shared_keys(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, value): (key, first, value) for each distinct value of a key that has several.

    ``first`` is the key's smallest value; its own row is given too.  Groups of any size stream through: only the last row and the
    group's first value are carried from batch to batch.
    """
    last_key = last_value = first = None
    opened = False  # the group's first row has been given
    for batch in batches:
        key, val = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", value))
        n = len(key)
        if not n:
            continue
        begins = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
        again = np.append(not begins[0] and val[0] == last_value, (key[1:] == key[:-1]) & (val[1:] == val[:-1]))
        at = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        firsts = np.where(at >= 0, val[at], first if first is not None else 0)
        more = (val != firsts) & ~again  # rows that show that their group has several values
        rows = np.flatnonzero(more)
        # The first row of each group that turns out shared here; for the carried group it may have been given before.
        heads = np.unique(at[rows])
        out_key, out_first, out_val = key[rows], firsts[rows], val[rows]
        carried = len(heads) and heads[0] == -1
        own = heads[heads >= 0]
        extra_key, extra_val = key[own], val[own]
        if carried and not opened:
            extra_key, extra_val = np.append(extra_key, last_key), np.append(extra_val, first)
        if len(out_key) or len(extra_key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(out_key, extra_key).astype(np.int64)), pa.array(np.append(out_first, extra_val).astype(np.int64)), pa.array(np.append(out_val, extra_val).astype(np.int64))], names=["key", "first", value]
            )
        tail = at[-1]
        opened = bool((at[rows] == tail).any()) or (tail == -1 and opened)
        last_key, last_value, first = int(key[-1]), int(val[-1]), int(firsts[-1])
