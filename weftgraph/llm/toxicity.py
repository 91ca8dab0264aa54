"""Toxicity grades by cumulative-link ordinal regression on sparse words.

P(grade <= j | x) = sigmoid(theta_j - w.x) with theta ascending: one weight for each word, shared by all thresholds.  x marks
which vocabulary words a text holds; the score w.x is not divided by the text's length, so a few insults in
a long text still count.  Output: P(grade >= j) for each j, expected severity (their sum), the likeliest grade and
whether the text is rejected, that is P(grade >= 1) >= ``reject``.

The model is fitted on at most ``sample`` labelled documents of each grade (those with the smallest hashes of their ids, so the choice
does not depend on partitioning); everything else covers all rows.  The vocabulary (words of at least ``least``
sampled documents whose share differs between grades) and so the model is bounded by ``words``.

Null text counts as empty: it holds no word, gets the prior and is never rejected, whatever the prior is.  Labels without a document, null labels and documents
without labels do not enter the fit; of repeated labels of one document the highest counts.  With no label of some grade,
nothing can be learned and every document gets grade 0 and severity 0.  An empty table gives no rows, repeated rows a row each; other columns are kept
by ``score`` only if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """A text's features: its words, and the first four and five letters of longer ones (marked by ``*``)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


@dataclass
class OrdinalModel:
    """Thresholds (ascending) and a weight for each vocabulary word."""

    thresholds: list[float]
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str]) -> np.ndarray:
        w, known = self.weights, self.weights.keys()
        return np.array([sum(map(w.__getitem__, known & words_of(t))) for t in texts])

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -40, 40)))


def fit(texts: Iterable[str], grades: list[int], words: int = 4096, least: int = 3, clear: float = 4.0, l2: float = 2e-4, l1: float = 2e-4, steps: int = 400, rate: float = 0.3) -> OrdinalModel:
    """Proximal Adam on the ordinal log-likelihood; sparse rows as index lists.  Texts are read one by one."""
    top = max(grades, default=0)
    if not top or len(set(grades)) < top + 1:
        return OrdinalModel([40.0] * max(top, 1))
    y = np.array(grades)
    # Features are numbered as they come, so the driver holds an integer for each word of the sample and each word once.
    number: dict[str, int] = {}
    bags = [np.fromiter({number.setdefault(w, len(number)) for w in words_of(t)}, np.int32) for t in texts]
    cols = np.concatenate(bags).astype(np.int64)
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    names = np.array(list(number), dtype=object)
    df = np.bincount(cols, minlength=len(names))
    hit = np.bincount(cols[y[rows] > 0], minlength=len(names))
    n, pos = len(y), int((y > 0).sum())
    # Gain of a word: how far its share of graded documents lies from the overall share, in standard deviations.
    share = pos / n
    gain = np.where(df >= least, np.abs(hit - df * share) / np.sqrt(df * share * (1 - share) + 1e-9), 0)
    chosen = sorted(np.flatnonzero(gain >= clear).tolist(), key=lambda i: (-gain[i], names[i]))[:words]
    vocabulary = sorted(names[i] for i in chosen)
    place = np.full(len(names), -1)
    place[[number[w] for w in vocabulary]] = np.arange(len(vocabulary))
    rows, cols = rows[place[cols] >= 0], place[cols][place[cols] >= 0]
    number = {w: i for i, w in enumerate(vocabulary)}
    classes = np.bincount(y, minlength=top + 1)
    weight = (n / ((top + 1) * classes))[y]  # grades count alike
    w = np.zeros(len(vocabulary))
    base = np.array([np.log(classes[: j + 1].sum() / classes[j + 1 :].sum()) for j in range(top)])
    gaps = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])  # first threshold, logs of the steps to the next
    params = np.concatenate([gaps, w])
    m, v = np.zeros_like(params), np.zeros_like(params)
    wide = lambda g: np.concatenate([g[:1], g[0] + np.cumsum(np.exp(g[1:]))])
    for step in range(1, steps + 1):
        theta, w = wide(params[:top]), params[top:]
        s = np.bincount(rows, weights=w[cols], minlength=n)
        edge = np.concatenate([[-60.0], theta, [60.0]])
        cdf = 1 / (1 + np.exp(-np.clip(edge[None, :] - s[:, None], -60, 60)))
        hi, lo = cdf[np.arange(n), y + 1], cdf[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        g_s = (d_hi - d_lo) / n  # of the negative log-likelihood by the score
        g_theta = np.array([-(d_hi[y == j].sum() - d_lo[y == j + 1].sum()) / n for j in range(top)])
        g_gaps = np.array([g_theta.sum(), *(np.exp(params[j]) * g_theta[j:].sum() for j in range(1, top))])
        grad = np.concatenate([g_gaps, np.bincount(cols, weights=g_s[rows], minlength=len(w)) + l2 * w])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        lr = rate * (1 - step / (steps + 1))
        params = params - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        params[top:] = np.sign(params[top:]) * np.maximum(np.abs(params[top:]) - lr * l1, 0)
    w = params[top:]
    return OrdinalModel([float(t) for t in wide(params[:top])], {x: float(w[i]) for x, i in number.items() if w[i]})


def training_rows(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = 4000) -> DataFrame:
    """(text, grade, doc_id) of at most ``sample`` documents of each grade: those with the smallest id hashes.  Of several rows with
    one id, that with the smallest hash of its text (then the smallest text) stands for it."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(grade).cast("int")).alias("grade"))
    graded = shared.table(graded.withColumn("_h", F.xxhash64("doc_id")).withColumn("_slot", F.shiftright("_h", 54)), "graded")
    # 1,024 slots of the hash's range for each grade: whole slots are in or out, rows are ranked only where the sample ends in a slot.
    whole, cut, before = [], [], {}
    for r in sorted(graded.groupBy("grade", "_slot").count().collect(), key=lambda r: (r["grade"], r["_slot"])):
        room = sample - before.get(r["grade"], 0)
        before[r["grade"]] = before.get(r["grade"], 0) + r["count"]
        if r["count"] <= room:
            whole.append((r["grade"], r["_slot"], r["count"]))
        elif room > 0:
            cut.append((r["grade"], r["_slot"], room))
    slots = graded.sparkSession.createDataFrame(whole + cut, "grade int, _slot long, _room long")
    ranked = graded.join(F.broadcast(slots), ["grade", "_slot"]).withColumn("_r", F.row_number().over(Window.partitionBy("grade", "_slot").orderBy("_h", "doc_id")))
    chosen = ranked.where(F.col("_r") <= F.col("_room")).select("doc_id", "grade")
    # At most ``sample`` ids of each grade are left: the broadcast is bounded, and so is what the aggregate keeps.
    own = shared.texts(docs).join(F.broadcast(chosen), "doc_id")
    return own.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select(F.col("t.text").alias("text"), "grade", "doc_id")


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = 4000, **options) -> OrdinalModel:
    """Fits on the bounded sample.  Words are cut on the executors; the driver gets the distinct words of at most ``sample`` documents of a grade."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [" ".join(sorted(set(_WORD.findall(t.lower())))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.string()), batch.column("grade"), batch.column("doc_id")], names=["text", "grade", "doc_id"])

    rows = training_rows(docs, labels, grade, sample).mapInArrow(bags, "text string, grade int, doc_id long")
    ranked = rows.collect()
    ranked.sort(key=lambda r: (r["grade"], r["doc_id"], r["text"]))
    return fit((r["text"] for r in ranked), [r["grade"] for r in ranked], **options)


def verdict(docs: DataFrame, model: OrdinalModel, reject: float = 0.5) -> Column:
    """A struct of expected_severity, grade, p_toxic and is_toxic for the text of each row; Python sees the texts alone, whatever else a row holds."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("expected_severity double, grade int, p_toxic double, is_toxic boolean")
    def grades(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for column in columns:
            slices = [b.column("text").to_pylist() for b in shared.slices([pa.record_batch([column], ["text"])])]
            above = m.at_least(np.concatenate([np.zeros(0), *map(m.scores, slices)]))
            worded = np.array([_WORD.search(t) is not None for texts in slices for t in texts], bool)
            likely = np.argmax(np.column_stack([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]]), axis=1)
            parts = [pa.array(above.sum(1).round(6)), pa.array(likely.astype(np.int32)), pa.array(above[:, 0].round(6)), pa.array((above[:, 0] >= reject) & worded)]
            yield pa.StructArray.from_arrays(parts, ["expected_severity", "grade", "p_toxic", "is_toxic"])

    return grades(F.coalesce(F.col("text"), F.lit("")))


_OWN = ("doc_id", "expected_severity", "grade", "p_toxic", "is_toxic")


def score(docs: DataFrame, model: OrdinalModel, reject: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, is_toxic of every row, and the columns in ``keep`` but those of these names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), verdict(docs, model, reject).alias("s"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keep if k not in _OWN]).alias("k"))
    return rows.select("doc_id", *[F.col("s")[c].alias(c) for c in _OWN[1:]], *[F.col("k")[k].alias(k) for k in keep if k not in _OWN])


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject; null and empty texts, and others without words, stay."""
    return docs.where(~verdict(docs, model, reject)["is_toxic"])
