"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct five-word shingles.  In a *band* (sizes between a power of two and the next) every
set of that size, and the sets of the band below that may reach into it, are XOR-hashed into a bit sketch of P blocks of 2**32
bits: each shingle flips one bit, so the Hamming distance of two sketches is a lower bound of the symmetric difference.  A pair with
Jaccard >= num/den differs in at most d = (den - num) (|A| + |B|) / (den + num) shingles, so of P > d blocks some
agree (pigeonhole).  Blocks are sparse and never stored: a block's key is the XOR of a code of each set bit, which flips with the bit.
If a set has more than d blocks in use, some block in use agrees, and it is found by joining on (band, block number, key).
The few sets with so many unused blocks also share one key of their band, so no pair is lost.

Equal sets form a class, known by 128 bits of hashes of the whole set; classes whose first 64 bits clash get others.  All work is on
classes.  Rows (key, class) are sorted within their shuffle partition and streamed; keys with the same classes become one *group*.
A class's id tells its size to some percent, which rules many pairs out; dense sketches rule pairs out by their Hamming distance before any text moves, a coarse
one of one to two bits a shingle those below a Jaccard of about 0.65, a fine one of four to eight bits those below about 0.735; exact verification then reads texts, dealt by the pair's first class, which is sent once for each salt of its partners.  Every class is compared first with the
nearest of its groups' smallest classes; then, round by round, with its nearest partner in another component of those that each task holds, found in cells of bounded size by coarse sketches and, for rows
that have a partner by these, by fine ones; when a round joins nothing, with all partners that are left.  Copies are never expanded into pairs and no group is capped.

Null text counts as empty; texts without words have an empty set and are linked with nothing; a null doc_id takes part in
links, and a component of nulls alone has a null id.  Repeated rows give a row each.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components, joined
from .hashing import mix, shingle_sets

#: Blocks of a band's sketch, as a multiple of the largest symmetric difference in it, and some more for the smallest sets.
_ROOM, _MORE = 1.1, 6
#: Bytes of dense sketches in one side of a cell when a group's pairs are compared; partners of a class for each copy of its text.
_CELL, _FAN = 4 << 20, 128

#: Levels of size at the end of a class's id.
_LEVELS = 512

U = np.uint64


def _starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and where the sets that are not empty begin."""
    n = np.diff(at)
    return n, at[:-1][n > 0]


def _level(n: np.ndarray) -> np.ndarray:
    """16 steps for each doubling of a set's size."""
    return np.minimum(np.floor(16 * np.log2(n)), _LEVELS - 1).astype(U)


def _near_sizes(a: str, b: str, num: int, den: int) -> Column:
    """False only where the sizes of two classes rule a link out; told from the ids alone."""
    return F.abs((F.col(a).bitwiseAND(_LEVELS - 1)) - (F.col(b).bitwiseAND(_LEVELS - 1))) <= math.ceil(16 * math.log2(den / num))


def class_ids(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: from the sum and the XOR of mixes of its members, so their order does not matter; the first ends in the size's level.  Empty sets get 0."""
    n, starts = _starts(at)
    out = np.zeros((2, len(n)), np.int64)
    if len(starts):
        a = np.add.reduceat(mix(hashes + U(1)), starts)
        b = np.bitwise_xor.reduceat(mix(hashes ^ U(0xA5A5A5A5)), starts)
        out[0, n > 0] = (mix(a ^ mix(b) ^ n[n > 0].astype(U)) & ~U(_LEVELS - 1) | _level(n[n > 0])).astype(np.int64)
        out[1, n > 0] = mix(a + mix(b ^ U(0x9E3779B97F4A7C15))).astype(np.int64)
    return out[0], out[1]


def _reach(n: np.ndarray, top: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference between a set of n shingles and a linked one of at most ``top``."""
    return (den - num) * (n + np.minimum(n * den // num, top)) // (den + num)


def keys_of(hashes: np.ndarray, at: np.ndarray, num: int = 3, den: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of each set, and the number of the set of each key."""
    n = np.diff(at)
    own = np.frexp(n.astype(float))[1].astype(np.int64) - 1
    doc = np.repeat(np.arange(len(n)), n)
    keys, sets = [], []
    for band in (own, own + 1):
        # A set that only an equal set can be linked with needs no key; sets of the band below take part where they reach into it.
        takes = (n > 0) & (_reach(n, n * den // num, num, den) > 0) & (n * den // num >= np.left_shift(1, np.maximum(band, 0)))
        if not takes.any():
            continue
        top = np.left_shift(2, np.maximum(band, 0)) - 1
        blocks = ((den - num) * 2 * top // (den + num) * _ROOM).astype(np.int64) + 2 + _MORE
        mine = takes[doc]
        d = doc[mine]
        bit = mix(hashes[mine] ^ (U(0x5851F42D4C957F2D) + band.astype(U))[d])
        place = (d.astype(U) << U(32)) | (((bit >> U(32)) * blocks.astype(U)[d]) >> U(32))
        order = np.argsort(place)
        place, code = place[order], mix((bit[order] & U(0xFFFFFFFF)) + U(0xD1B54A32D192ED03))
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        s = (place[first] >> U(32)).astype(np.int64)
        block, value = place[first] & U(0xFFFFFFFF), np.bitwise_xor.reduceat(code, first)
        keys.append(mix(value ^ mix(block * U(1000003) + band.astype(U)[s])))
        sets.append(s)
        few = np.flatnonzero(takes & (np.bincount(s, minlength=len(n)) <= _reach(n, top, num, den)))
        keys.append(mix(U(0xFFFF0000) + band[few].astype(U)))
        sets.append(few)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).astype(np.int64), np.concatenate(sets)


def parity_keys(s: np.ndarray, num: int = 3, den: int = 4) -> np.ndarray:
    """The join keys of one set: (band, block number, block) of each used block, in its own band and the next if it reaches there."""
    return np.unique(keys_of(s, np.array([0, len(s)]), num, den)[0])


#: Bits of a fine sketch for each of a coarse one, and bits that a fine one has at least: two that differ in d shingles lose about d * d / bits of them to collisions.
_FINE, _LEAST = 4, 4096


def dense_sketches(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's fine sketch: four times as many bits as the smallest set of the next band has shingles, at least ``_LEAST``."""
    n = np.diff(at)
    size = np.maximum(np.left_shift(2 * _FINE, np.maximum(np.frexp(n.astype(float))[1] - 1, 0)), _LEAST).astype(np.int64)
    base = np.append(0, np.cumsum(size))
    doc = np.repeat(np.arange(len(n)), n)
    at_bit = base[doc] + (mix(hashes ^ U(0xC2B2AE3D27D4EB4F)) & (size - 1).astype(U)[doc]).astype(np.int64)
    data = np.packbits((np.bincount(at_bit, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    ends = (base // 8).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def coarse(sketch: bytes, n: int) -> bytes:
    """The sketch of a set of ``n`` folded to as many bits as the smallest set of the next band has shingles, at least 64."""
    words = max((2 << max(n.bit_length() - 1, 0)) // 64, 1)
    return np.bitwise_xor.reduce(np.frombuffer(sketch, U).reshape(-1, words), axis=0).tobytes()


def _sketch_bytes(classes: Column, bits: str) -> Column:
    """How long a class's coarse (bits) or fine sketch is, told from its id alone."""
    doubled = F.shiftright(classes.bitwiseAND(_LEVELS - 1), 4).cast("int")
    one = F.lit(1).cast("long")
    return F.greatest(F.call_function("shiftleft", one, doubled) * (2 if bits == "bits" else 2 * _FINE), F.lit(64 if bits == "bits" else _LEAST)) / 8


def _folded(sketches: list[bytes]) -> np.ndarray:
    """One row of 64-bit words for each sketch, all of the shortest one's length: halves XORed keep the lower bound."""
    least = min(map(len, sketches))
    rows = np.empty((len(sketches), least // 8), U)
    for i, x in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, least // 8), axis=0)
    return rows


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches, folded to one length."""
    a, b = _folded([x, y])
    return int(np.bitwise_count(a ^ b).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def met_before(seen: set[int], classes: np.ndarray, checks: np.ndarray) -> list[bool]:
    """Which sets are in ``seen``, by both of their hashes, so that two sets which share the first each get a sketch; adds them."""
    out = []
    for c, k in zip(classes.tolist(), checks.tolist()):
        out.append((whole := (c << 64) ^ (k & (1 << 64) - 1)) in seen)
        seen.add(whole)
    return out


def sets_of(docs: DataFrame, words: int = 5) -> DataFrame:
    """Of every row: row (a number of its own), doc_id, n, class, check, bits and fine (the sketches, once for each class and task, else null) and d, the columns of ``docs``."""
    kinds = {"n": pa.int64(), "class": pa.int64(), "check": pa.int64(), "bits": pa.binary(), "fine": pa.binary()}

    @F.arrow_udf("n long, class long, check long, bits binary, fine binary")
    def sketch(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: set[int] = set()
        for column in columns:
            parts = []
            for batch in shared.slices([pa.record_batch([column], ["text"])], most=2 << 20):
                hashes, at = shingle_sets([t.encode() for t in batch.column("text").to_pylist()], words)
                (classes, checks), bits, sizes = class_ids(hashes, at), dense_sketches(hashes, at), np.diff(at)
                for i, again in enumerate(met_before(seen, classes, checks)):
                    if again or not sizes[i]:
                        bits[i] = None
                if len(seen) > 1_000_000:  # bounded: a class that was forgotten is given again
                    seen = set()
                folded = [None if b is None else coarse(b, n) for b, n in zip(bits, sizes.tolist())]
                parts.append(pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip((sizes, classes, checks, folded, bits), kinds.values())], list(kinds)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(kinds))

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own, sketch(F.coalesce("text", F.lit(""))).alias("s"))
    held = shared.table(rows.select("row", "doc_id", "d", "s.*"), "sets")
    # Sets that only the second hash tells apart: none is expected below 10**9 sets, some hundreds at 10**11.
    clashing = held.where("n > 0").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("class").collect()
    if clashing:
        held = held.withColumn("class", F.when(F.col("class").isin([r["class"] for r in clashing]), F.xxhash64("class", "check").bitwiseAND(-_LEVELS).bitwiseOR(F.col("class").bitwiseAND(_LEVELS - 1))).otherwise(F.col("class")))
    return held


def _texts(held: DataFrame) -> DataFrame:
    """(row, class, text) of one row, or a few, of each class."""
    return held.where(F.col("bits").isNotNull()).select("row", "class", F.col("d")["text"].alias("text"))


def shared_groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, class): (key, first, class) of every key that several classes share; ``first`` is the smallest.

    Keys of at most ``most`` classes get a hash of their classes for a key, so keys with the same classes are given once (or again after a
    million others).  A larger key streams through under its own name.
    """
    seen: set[tuple[int, int]] = set()
    carry = np.zeros((2, 0), np.int64)
    hot: tuple[int, int] | None = None  # key and first class of a large group that goes on

    def out(key: np.ndarray, first: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(first), pa.array(cls)], names=["key", "first", "class"])

    def groups(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal seen
        if not len(k):
            return
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        k, c = k[new], c[new]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(at, len(k)))
        name = mix(np.add.reduceat(mix(c.astype(U)), at) ^ mix(size.astype(U))).astype(np.int64)
        keep = size > 1
        for i, pair in zip(np.flatnonzero(keep).tolist(), zip(name[keep].tolist(), c[at][keep].tolist())):
            if pair in seen:
                keep[i] = False
            seen.add(pair)
        if len(seen) > 1_000_000:
            seen = set()
        rows = np.repeat(keep, size)
        if rows.any():
            yield out(np.repeat(name, size)[rows], np.repeat(c[at], size)[rows], c[rows])

    for batch in batches:
        k, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "class"))
        if hot is not None:
            n = int(np.searchsorted(k != hot[0], True))
            if n:
                yield out(k[:n], np.full(n, hot[1]), c[:n])
            if n == len(k):
                continue
            k, c, hot = k[n:], c[n:], None
        k, c = np.append(carry[0], k), np.append(carry[1], c)
        if not len(k):
            continue
        last = int(np.flatnonzero(k == k[-1])[0])
        yield from groups(k[:last], c[:last])
        carry = np.stack([k[last:], c[last:]])
        if carry.shape[1] > most and carry[1][0] != carry[1][-1]:
            hot = (int(carry[0][0]), int(carry[1][0]))
            yield out(carry[0], np.full(carry.shape[1], hot[1]), carry[1])
            carry = np.zeros((2, 0), np.int64)
    yield from groups(*carry)


def candidates(held: DataFrame, words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(key, first, class): the classes of every group; ``first`` is the smallest."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, most=2 << 20):
            hashes, at = shingle_sets([t.encode() for t in batch.column("text").to_pylist()], words)
            keys, sets = keys_of(hashes, at, num, den)
            order = np.argsort(sets, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(sets, minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[order]))], names=["class", "keys"])

    rows = _texts(held).select("class", "text").mapInArrow(emit, "class long, keys array<long>").select(F.explode("keys").alias("key"), "class")
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "key").sortWithinPartitions("key", "class")
    return shared.table(ordered.mapInArrow(shared_groups, "key long, first long, class long").distinct(), "candidates")


def _near(pairs: DataFrame, sketches: DataFrame, bits: str, num: int, den: int) -> DataFrame:
    """The pairs (a, b), with the distance of their sketches, that sizes and sketches don't rule out."""
    x, y = (sketches.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col(bits).alias(f"bits_{k}")) for k in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            far = np.array([apart(p.as_buffer(), q.as_buffer()) for p, q in zip(batch.column("bits_a"), batch.column("bits_b"))], np.int64)
            ok = pa.array((np.minimum(n, m) * den >= np.maximum(n, m) * num) & (far * (den + num) <= (n + m) * (den - num)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far)], names=["a", "b", "far"]).filter(ok)

    return shared.table(pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long, far long"), "near")


def _verify(pairs: DataFrame, held: DataFrame, reps: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked; texts move once to meet their pairs, and once to the pair's first class and salt."""
    pairs = pairs.select("a", "b").distinct()
    often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _FAN).alias("salts"))
    salted = shared.table(pairs.join(often, "a").select("a", F.expr("pmod(xxhash64(b), salts)").alias("salt"), "b"), "pairs")
    need = salted.select(F.col("b").alias("class"), "a", "salt", "b").unionByName(salted.select(F.col("a").alias("class"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct())
    texts = need.join(reps.select("class", "row"), "class").join(_texts(held).select("row", "text"), "row").select("a", "salt", "b", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros(0, U)
        for batch in shared.slices(batches, most=2 << 20):
            hashes, at = shingle_sets([t.encode() for t in batch.column("text").to_pylist()], words)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for i in range(len(a)):
                own = hashes[at[i] : at[i + 1]]
                if b[i] is None:
                    left = own.copy()
                elif linked(left, own, num, den):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], names=["a", "b"])

    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared.table(texts.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(check, "a long, b long"), "verified")


_FAR = 1 << 30


def _cells(rows: DataFrame, sketches: DataFrame, bits: str, want: str, num: int, den: int) -> DataFrame:
    """Of rows (key, class, part), by sketches, what may be linked among the classes of one key and different parts: the ``rows`` (key, class) that have any such partner, for each
    class the ``nearest`` partner of those that each task meets, the nearest for each other part, as (class, other), or all ``pairs`` (a, b).  A task gives a class once, so its rows are no more than its classes.

    A key's rows are dealt in cells: pairs of its slices, each slice of about ``_CELL`` bytes of sketches, so a cell fits a task however many rows a key has.
    """
    names = {"rows": ["key", "class"], "nearest": ["class", "far", "other", "there"], "pairs": ["a", "b"]}[want]
    own = sketches.select("class", "n", F.col(bits).alias("bits"))
    sizes = rows.groupBy("key").agg(F.ceil(F.sum(_sketch_bytes(F.col("class"), bits)) / _CELL).cast("int").alias("k"))
    placed = rows.select("key", "class", "part").join(sizes, "key").withColumn("s", F.expr("cast(pmod(xxhash64(class), k) as int)"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") == F.least("s", "o")).alias("left"), "class", "part").join(own, "class")

    def distances(c: list[tuple], one: bool) -> np.ndarray:
        """How far the rows of a cell are apart, _FAR where they are ruled out or are not this cell's to compare."""
        left, _, part, n = (np.array(x) for x in zip(*(r[:4] for r in c)))
        x, out = _folded([r[4] for r in c]), np.empty((len(c), len(c)), np.int64)
        step = max(1, (1 << 21) // max(1, x.size))
        for a in range(0, len(c), step):
            i = slice(a, a + step)
            far = np.bitwise_count(x[i, None, :] ^ x[None, :, :]).sum(axis=2, dtype=np.int64)
            ok = (part[i, None] != part[None, :]) & (np.minimum(n[i, None], n[None, :]) * den >= np.maximum(n[i, None], n[None, :]) * num) & (far * (den + num) <= (n[i, None] + n[None, :]) * (den - num))
            out[i] = np.where(ok if one else ok & (left[i, None] != left[None, :]), far, _FAR)
        return out

    def close(cell: tuple, c: list[tuple], out: list[tuple], seen: set[tuple], best: dict[int, tuple]) -> None:
        if len(c) < 2:
            return
        far = distances(c, cell[1] == cell[2])
        if want == "pairs":
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(far < _FAR)))):
                pair = (min(c[i][1], c[j][1]), max(c[i][1], c[j][1]))
                if pair not in seen:
                    seen.add(pair)
                    out.append(pair)
            if len(seen) > 1_000_000:  # a task gives a pair once; bounded, as a miss only gives it again
                seen.clear()
            return
        if want == "rows":
            out.extend((cell[0], c[i][1]) for i in np.flatnonzero(far.min(axis=1) < _FAR).tolist())
            return
        at = far.argmin(axis=1)
        for i, (j, d) in enumerate(zip(at.tolist(), far[np.arange(len(c)), at].tolist())):
            if d < _FAR and (d, c[j][1]) < best.get(c[i][1], (_FAR,))[:2]:
                best[c[i][1]] = (d, c[j][1], c[j][2])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        best: dict[int, tuple] = {}  # of each class that the task has met, whatever the number of keys and cells: (far, other, there)
        cell, held, out = None, [], []
        full = lambda: pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(len(names))], names=names)
        for batch in shared.slices(batches, column="bits", most=4 << 20):
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("key", "i", "j"))))
            for key, row in zip(keys, zip(*(batch.column(x).to_pylist() for x in ("left", "class", "part", "n", "bits")))):
                if key != cell:
                    if cell is not None:
                        close(cell, held, out, seen, best)
                    cell, held = key, []
                held.append(row)
            if len(best) > 1_000_000:  # bounded: what is told again is told apart when the tasks' rows meet
                out.extend((c, *b) for c, b in best.items())
                best.clear()
            if out:
                yield full()
                out = []
        if cell is not None:
            close(cell, held, out, seen, best)
        out.extend((c, *b) for c, b in best.items())
        if out:
            yield full()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    got = cells.mapInArrow(work, ", ".join(f"{c} long" for c in names))
    if want == "nearest":
        best = got.groupBy("class", "there").agg(F.min(F.struct("far", "other")).alias("m"))
        return shared.table(best.select("class", F.col("m.other").alias("other")), "nearest")
    return shared.table(got.distinct(), "cells")


def _apart(rows: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """(key, class, part) of the keys with ``least`` classes or more, in several components (parts)."""
    named = rows.select("key", "class").join(label.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("part"))
    split = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("lo") != F.col("hi")) & (F.col("n") >= least)).select("key")
    return shared.table(named.join(split, "key"), "unsettled")


def class_components(held: DataFrame, words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(node, component) of the classes that are linked; component is the smallest class reachable.  Only links between components are verified, enough to join all that are linked."""
    found = candidates(held, words, num, den)
    reps = held.where(F.col("bits").isNotNull()).groupBy("class").agg(F.min("row").alias("row"))
    reps = shared.table(found.select("class").distinct().join(reps, "class"), "representatives")
    sketches = shared.table(held.where(F.col("bits").isNotNull()).select("row", "n", "bits", "fine").join(reps, "row").select("class", "n", "bits", "fine"), "sketches")
    near = _near(found.where((F.col("first") != F.col("class")) & _near_sizes("first", "class", num, den)).select(F.col("first").alias("a"), F.col("class").alias("b")).distinct(), sketches, "bits", num, den)
    # First each class meets the nearest of the first classes of its groups.
    stars = near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select("m.a", "b")
    label = components(_verify(stars, held, reps, words, num, den))
    # Then, in groups of three or more that lie in several components, each class its nearest partners in others, round by round while that joins any.  Rows without a
    # partner left are out for good, as components only grow.
    rest = _apart(found, label, 3)
    rest = shared.table(rest.join(_cells(rest, sketches, "bits", "rows", num, den), ["key", "class"]), "unsettled")
    while True:
        partners = _cells(rest, sketches, "fine", "nearest", num, den)
        more = _verify(partners.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")), held, reps, words, num, den)
        if not more.limit(1).count():
            break
        label = joined(label, more)
        rest = _apart(rest.join(partners.select("class").distinct(), "class", "left_semi"), label, 2)
    # Last, whatever pair of such a group is left, and of the pairs with a group's first class: all that is linked is now joined.
    last = _cells(rest.join(partners.select("class").distinct(), "class", "left_semi"), sketches, "fine", "pairs", num, den)
    x, y = label.select(F.col("node").alias("a"), F.col("component").alias("pa")), label.select(F.col("node").alias("b"), F.col("component").alias("pb"))
    across = near.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")
    across = _near(across, sketches, "fine", num, den).select("a", "b")
    return joined(label, _verify(last.unionByName(across), held, reps, words, num, den))


def component_of(held: DataFrame, words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(class, component, component_id) of every class that is not empty: the smallest class linked with it, and the smallest doc_id."""
    label = class_components(held, words, num, den).withColumnRenamed("node", "class")
    classes = held.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = classes.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return shared.table(named.join(least, "component").select("class", "component", "component_id"), "components")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) of every row."""
    held = sets_of(docs.select("doc_id", "text"), words)
    members = held.select("doc_id", F.col("n").alias("n_shingles"), "class")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.join(component_of(held, words, num, den), "class", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that with the smallest doc_id (null last, then the first row).  Each row is judged by its own
    text, whatever its doc_id; texts without words are linked with nothing and stay."""
    held = sets_of(docs, words)
    members = held.where("n > 0").select("row", "doc_id", "class").join(component_of(held, words, num, den), "class")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = members.groupBy("component").agg(F.min(order).alias("first")).select("first.row")
    kept = held.join(first, "row", "left_semi").select("d").unionByName(held.where("n = 0").select("d"))
    return kept.select(*[F.col("d")[c].alias(c) for c in docs.columns])
