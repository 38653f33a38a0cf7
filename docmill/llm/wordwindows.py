"""Passages of words that occur twice: every window of ``size`` words that also starts anywhere else.

Windows are compared as sequences of words ``[^\\x20\\x09-\\x0D]+``, so the white space between them doesn't matter; the
same document counts as elsewhere and overlaps count. A window belongs to its least gram, the run of ``size // 3``
words of least hash in it (the first of equal ones), which depends on nothing but the window: equal windows have equal
grams. Grams that occur once leave after one aggregation on an 8-byte key; for the others a bitmap of fixed size
decides which windows go on, and these are counted by 128 bits. The bitmap lets some through for nothing and loses none.

One row leaves per gram, about one in ``size / 3`` words, and one per window of a repeated gram; texts are never
shuffled. A long text goes in pieces that overlap by a window, so only its bytes and word places are held whole.

Defined results: a null text is empty; a text of fewer than ``size`` words has no window; equal texts repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.shared import bounded_batches, filter_place, hash_filter, written

#: Bytes of text, or of words of a longer text, that one vectorised step handles.
STEP = 1 << 18
_BASES = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D

_WINDOWS = "digest binary, windows array<struct<h: long, h2: long, a: int, b: int>>"


class Windows:
    """The windows of some words, given by their places in ``data``: ``at`` is a window's first word, ``row`` its text,
    ``key`` the hash of its least gram, and ``new`` where another gram begins."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, size: int):
        self.size, gram = size, max(1, size // 3)
        per = np.maximum(0, np.diff(before) - size + 1)
        self.at, self.row = textcore.take_ranges(before[:-1], per), np.repeat(np.arange(len(per)), per)
        self.key = np.zeros(0, np.uint64)
        self.new = np.zeros(0, bool)
        if not len(self.at):
            return
        self.word = textcore.span_hash(textcore.prefix_hash(data), start, end)
        self.prefix = _prefix(self.word, _BASES[0])
        grams = _sequence(self.prefix, np.arange(len(start) - gram + 1), gram, _BASES[0])
        low = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        span, reach = 1, size - gram + 1
        while 2 * span <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < reach:
            low = np.minimum(low[: -(reach - span)], low[reach - span :])
        place = (low[self.at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.key = grams[place]
        self.new = np.concatenate([[True], (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])])

    def hashes(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[own]
        return _sequence(self.prefix, at, self.size, _BASES[0]), _sequence(_prefix(self.word, _BASES[1]), at, self.size, _BASES[1])


def _prefix(word: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * textcore.powers(pow(base, -1, 1 << 64), len(word)), out=out[1:])
    return out


def _sequence(prefix: np.ndarray, at: np.ndarray, n: int, base: int) -> np.ndarray:
    """64-bit hash of the n words from each place on, independent of where they lie."""
    return textcore.mix((prefix[at + n] - prefix[at]) * textcore.powers(base, len(prefix))[at])


def _steps(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[Windows, int, np.ndarray, np.ndarray]]:
    """(windows, row of their first text, start and end of words within the text), step by step."""
    for a, b in textcore.steps(offsets, STEP):
        part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, before = textcore.words(part, inner)
        if b - a > 1 or len(part) <= STEP:
            yield Windows(part, start, end, before, size), a, start - np.repeat(inner[:-1], np.diff(before)), end - np.repeat(inner[:-1], np.diff(before))
            continue
        first = 0
        while first + size <= len(start):
            last = max(first + 2 * size, int(np.searchsorted(start, start[first] + STEP)))
            last = min(last, len(start))
            s, e = start[first:last], end[first:last]
            yield Windows(part[s[0] : e[-1]], s - s[0], e - s[0], np.array([0, len(s)]), size), a, s, e
            first = last - size + 1


def _keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for windows, *_ in _steps(*textcore.flat_text(batch.column(0)), size):
                yield pa.RecordBatch.from_arrays([pa.array(windows.key[windows.new].view(np.int64))], names=["k"])

    return run


def _wanted(size: int, bits):
    """A row for each text, or piece of a long one, with windows whose gram the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for windows, row, start, end in _steps(*textcore.flat_text(batch.column(1)), size):
                place = filter_place(windows.key.view(np.int64), 8 * len(bits.value))
                own = np.flatnonzero((bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                if not len(own):
                    continue
                at = windows.at[own]
                columns = [*(x.view(np.int64) for x in windows.hashes(own)), start[at].astype(np.int32), end[at + size - 1].astype(np.int32)]
                rows, first = np.unique(windows.row[own], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in columns], ["h", "h2", "a", "b"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + rows)), lists], names=["digest", "windows"])

    return run


def repeated_windows(docs: DataFrame, size: int, digest: str = "digest", text: str = "text") -> DataFrame | None:
    """(digest, runs): the places (a, b) in bytes, from the first word's start to the last one's end, of the windows that
    occur twice, a row per text or piece of one that has any; None if no gram occurs twice. ``digest`` names a text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keys = docs.select(text).mapInArrow(_keys(size), "k long")
    twice = written(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeated-grams")
    n = twice.count()
    if not n:
        return None
    found = docs.select(digest, text).mapInArrow(_wanted(size, hash_filter(twice, "k", n)), _WINDOWS)
    found = written(found.withColumn("tid", F.monotonically_increasing_id()), "windows")
    each = found.select("tid", F.inline("windows"))
    again = written(each.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h", "h2"), "repeated-windows")
    runs = each.join(again, ["h", "h2"]).groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return runs.join(found.select("tid", "digest"), "tid").select("digest", "runs")
