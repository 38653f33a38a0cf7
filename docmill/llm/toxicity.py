"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are words and word beginnings, counted and divided by the root of the text's words. One weight per feature is
shared by all thresholds: P(severity > k) = sigmoid(w . x - cut_k), with cuts in ascending order, so the
model answers "how severe", not one question per grade. The prediction is the expected severity, the sum
of P(severity > k).

Labels tell toxic from not; grades are made from them: 0 for clean rows, and 1 .. GRADES for toxic rows by
the strength of features that occur in toxic rows far above their share. The fit reads at most ``FIT_ROWS``
labelled rows, those with the least hash of their id: a documented, bounded sample. Scoring reads every
whole text; it ships the model, at most ``MAX_FEATURES`` weights, to the tasks.

Defined results: null or empty text has no features and the severity of the cuts alone; rows without a
label take no part in the fit; repeated rows are scored alike; without both kinds of labels, or a feature
that tells them apart, nothing is toxic (severity 0); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.shared import bounded_batches

#: Characters of a word's beginning that is a feature of its own.
BEGIN = 4
GRADES = 3
#: Labelled rows that the fit reads at most, and features that it keeps at most.
FIT_ROWS = 8_000
MAX_FEATURES = 1 << 14
#: A feature must occur in this share of the toxic rows, in so many of them, and as rows go so many times
#: (as a logarithm) more often than in clean rows. Words of a few near copies thus don't count.
MIN_SHARE, MIN_ROWS, MIN_ODDS = 0.05, 5, 2.0
#: Expected severity from which a document is rejected.
REJECT = 0.2
STEPS = 400
STEP = 1 << 19
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature hash, count) of every document's features, and the words per document.

    Words are lower-cased (A-Z) and lose up to three ASCII punctuation marks at either end.
    """
    text = textcore.lower_ascii(data)
    start, end, _ = textcore.words(text, offsets)
    for _ in range(3):
        if len(start):
            start = start + ((end > start) & _EDGE[text[np.minimum(start, len(text) - 1)]])
            end = end - ((end > start) & _EDGE[text[end - 1]])
    start, end = start[end > start], end[end > start]
    doc = np.searchsorted(offsets, start, "right") - 1
    prefix = textcore.prefix_hash(text)
    whole = textcore.span_hash(prefix, start, end)
    characters = np.flatnonzero((text & 0xC0) != 0x80)
    first = np.searchsorted(characters, start)
    stop = np.append(characters, len(text))[np.minimum(first + BEGIN, len(characters))]
    long = stop < end
    head = textcore.mix(textcore.span_hash(prefix, start[long], stop[long]) ^ np.uint64(0xA5A5A5A5))
    of, key = np.concatenate([doc, doc[long]]), np.concatenate([whole, head])
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])) if len(of) else np.zeros(0, np.int64)
    return of[new], key[new], np.diff(np.append(new, len(of))), np.bincount(doc, minlength=len(offsets) - 1)


@dataclass
class OrdinalModel:
    """Feature hashes in ascending order, their weights, and ascending cuts."""

    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, key, count, words = features(data, offsets)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        weight = np.where(self.keys[at] == key, self.weights[at], 0.0) if len(self.keys) else np.zeros(len(key))
        score = np.bincount(doc, weight * strength(doc, count, words), len(offsets) - 1)
        return _sigmoid(score[:, None] - self.cuts[None, :]).sum(axis=1)


def strength(doc: np.ndarray, count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature's value: its count over the root of the text's words, tenfold."""
    return 10 * count / np.sqrt(np.maximum(words, 1))[doc]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(doc: np.ndarray, key: np.ndarray, value: np.ndarray, toxic: np.ndarray, grades: int = GRADES, steps: int = STEPS) -> OrdinalModel:
    """Fits shared weights and cuts on rows 0 .. len(toxic)-1, whose features are (doc, key, value)."""
    n = len(toxic)
    n1, n0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(grades, 40.0))
    if not n1 or not n0:
        return none
    keys, col = np.unique(key, return_inverse=True)
    of_toxic = np.bincount(col, toxic[doc] == 1, len(keys))
    of_clean = np.bincount(col, toxic[doc] == 0, len(keys))
    odds = np.log((of_toxic + 0.5) / (n1 + 1)) - np.log((of_clean + 0.5) / (n0 + 1))
    used = np.flatnonzero((of_toxic >= max(MIN_ROWS, MIN_SHARE * n1)) & (odds > MIN_ODDS))
    used = np.sort(used[np.argsort(-of_toxic[used], kind="stable")[:MAX_FEATURES]])
    if not len(used):
        return none
    index = np.full(len(keys), -1)
    index[used] = np.arange(len(used))
    keep = index[col] >= 0
    doc, col, value = doc[keep], index[col[keep]], value[keep]
    density = np.bincount(doc, value, n)
    grade = np.zeros(n, np.int64)
    own = density[toxic == 1]
    grade[toxic == 1] = 1 + np.searchsorted(np.quantile(own, np.arange(1, grades) / grades), own, "right")

    above = (grade[:, None] > np.arange(grades)[None, :]).astype(float)
    w, cuts = np.zeros(len(used)), np.linspace(1.0, 3.0, grades)
    m, v = np.zeros(len(w) + grades), np.zeros(len(w) + grades)
    for step in range(1, steps + 1):
        score = np.bincount(doc, w[col] * value, n)
        gap = (_sigmoid(score[:, None] - cuts[None, :]) - above) / n
        grad = np.concatenate([np.bincount(col, gap.sum(axis=1)[doc] * value, len(w)) + 1e-4 * w, -gap.sum(axis=0)])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w = w - move[: len(w)]
        cuts = np.sort(cuts - move[len(w) :])
    return OrdinalModel(keys[used], w, cuts)


def fit_labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id") -> OrdinalModel:
    """Fits on the labelled documents of least id hash (ties by id), at most ``rows`` of them.

    Their features, not their texts, come to the driver. An id with several labels counts as toxic if one
    says so; of several documents with one id the first by text hash is read.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col(key).cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)")
    there = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h")).groupBy("key").agg(F.min("h").alias("h"))
    marks = marks.groupBy("key").agg(F.max("toxic").alias("toxic")).join(there, "key").orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(marks), ["key", "h"]).select("key", "toxic", "text")  # the mark side has at most ``rows`` small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(2))
            for a, b in textcore.steps(offsets, STEP):
                doc, hashes, count, words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(doc, np.arange(b - a + 1))
                value = strength(doc, count, words).astype("<f4")
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), cut(hashes), cut(value)], names=["key", "toxic", "hashes", "value"])

    got = picked.mapInArrow(run, "key long, toxic int, hashes binary, value binary").collect()
    got = list({(r["hashes"], r["value"]): r for r in sorted(got, key=lambda r: r["key"])}.values())  # equal texts count once
    hashes = [np.frombuffer(r["hashes"], "<u8") for r in got]
    doc = np.repeat(np.arange(len(got)), [len(h) for h in hashes])
    value = [np.frombuffer(r["value"], "<f4") for r in got]
    join = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
    return fit(doc, join(hashes, np.uint64), join(value, np.float64), np.array([r["toxic"] for r in got], np.int64))


def severity(docs: DataFrame, model: OrdinalModel, text: str = "text", key: str = "doc_id", reject: float = REJECT) -> DataFrame:
    """key, severity (expected, from 0 to GRADES), rejected (severity of at least ``reject``)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                s = sent.value.severity(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array(s >= reject)], names=[key, "severity", "rejected"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, severity double, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows below ``reject``, with all their columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(at))
            for a, b in textcore.steps(offsets, STEP):
                s = sent.value.severity(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(s < reject))

    return docs.mapInArrow(run, docs.schema)
