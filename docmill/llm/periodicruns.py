"""Periodic runs of words, by enumeration of maximal pairs.

A run is a stretch of words with smallest period q that repeats at least ``MIN_REPEATS`` times, has at least
``MIN_LENGTH`` words, and that no neighbouring word extends with the same period.

**Method.** A document's suffixes are sorted by prefix doubling, those of a whole batch in the same numpy
passes, and neighbours' common prefixes are read off the ranks of every doubling. The tree of LCP intervals
is then walked bottom-up. An interval of common prefix ``l`` holds its suffixes by place, each with the class
of the word to its left; where two children meet, places next to each other that differ in that class are a
maximal pair ``(i, j, l)``: equal words from both, not to be extended on either side. If their distance
``p = j - i`` is at most ``l / (MIN_REPEATS - 1)``, the words from ``i`` to ``j + l`` are a run of period p,
whole as it is: nothing is extended afterwards. Within that distance all places of one interval lie evenly
spaced, so a run's pair of smallest distance is one of neighbours; a pair at a multiple of the period has
the same ends and gives way to it.

**Work.** Only suffixes that can stand in such a pair enter the tree: for some doubling L another suffix with
the same L words lies within ``2 L / (MIN_REPEATS - 1)``. Others change no interval of those. The smaller of
two lists goes into the larger one, so n suffixes cost O(n log n) steps.

Words are ``[^\\x20\\x09-\\x0D]+``, compared within a document by 64-bit hashes. Defined results: a null or empty
text, or one without words, has no runs and collapses to the empty string; repeated rows and null keys are
treated like any others; an empty table gives no rows. Rows stay in their partitions: no shuffle. A document is
one step of one task, whatever its length; its ranks take about 4 bytes a word and doubling.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.shared import bounded_batches

MIN_LENGTH = 6
MIN_REPEATS = 4
#: Bytes of text that one vectorised step handles.
STEP = 1 << 19

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def _ranks(values: np.ndarray, last: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks by doubling, needed) of the suffixes of ``values``; suffix i ends before ``last[i]``.

    ``ranks[k][i] == ranks[k][j]`` where the first 2**k values are the same; the last of the ranks is the
    suffixes' order. ``needed`` marks those that can stand in a pair that makes a run.
    """
    n = len(values)
    order = np.argsort(values, kind="stable").astype(np.int32)
    same = _same_as_before(values[order])
    first = np.where(same, 0, np.arange(n, dtype=np.int32))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(first)
    needed = np.zeros(n, bool)
    levels, size = [rank], 1
    shared = same.copy()
    shared[:-1] |= same[1:]
    active = order[shared]  # by rank, then by place
    while len(active):
        nxt = active.astype(np.int64) + size
        inside = nxt < last[active]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        size *= 2
        same = _same_as_before(key)
        # a class keeps the number of its first place in the order of all: that of the old class and what precedes
        fresh_old = ~_same_as_before(key // (n + 1))
        at = np.arange(len(active))
        within = at - np.maximum.accumulate(np.where(fresh_old, at, 0))
        number = (key // (n + 1)) + np.where(same, 0, within)
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(same, 0, number)).astype(np.int32)
        levels.append(rank)
        near = np.zeros(len(active), bool)
        near[1:] = same[1:] & ((MIN_REPEATS - 1) * (active[1:] - active[:-1]) < 2 * size)
        needed[active[near]] = True
        needed[active[:-1][near[1:]]] = True
        shared = same.copy()
        shared[:-1] |= same[1:]
        active = active[shared]
    return levels, needed


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a[k] and b[k]."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    end_a, end_b, begin = last[a], last[b], a.copy()
    top = len(last) - 1
    for k in range(len(levels) - 1, -1, -1):
        equal = (a < end_a) & (b < end_b) & (levels[k][np.minimum(a, top)] == levels[k][np.minimum(b, top)])
        a += equal << k
        b += equal << k
    return a - begin


def _pairs(places: list[int], common: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs that make runs, from suffixes in their order.

    ``common[k]`` is the common prefix of suffixes k - 1 and k. A stack holds (places in order, common prefix
    with the entry below); an entry is joined to the one below once no later suffix belongs to it alone.
    """
    least = min(-(-MIN_LENGTH * (MIN_REPEATS - 1) // MIN_REPEATS), MIN_LENGTH - 1)
    stack: list[tuple[list[int], int]] = []

    def join() -> Iterator[tuple[int, int, int]]:
        some, l = stack.pop()
        more, below = stack.pop()
        if len(some) > len(more):
            some, more = more, some
        reach, size = l // (MIN_REPEATS - 1), len(more)
        for i in some:
            at = bisect_left(more, i)
            if at < size and (p := more[at] - i) <= reach and p + l >= MIN_LENGTH and left[i] != left[more[at]]:
                yield i, l + p, p
            if at and (p := i - more[at - 1]) <= reach and p + l >= MIN_LENGTH and left[i] != left[more[at - 1]]:
                yield more[at - 1], l + p, p
        if 8 * len(some) < size:
            for i in some:
                insort(more, i)
        else:
            more += some
            more.sort()
        stack.append((more, below))

    for i, l in zip(places, common, strict=True):
        while len(stack) > 1 and stack[-1][1] > l:
            yield from join()
        if l < least:  # nothing above here can make a run
            stack.clear()
        stack.append(([i], l))
    while len(stack) > 1:
        yield from join()


def find_runs(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    ``values`` are the words' 64-bit hashes, one document after the other; ``before`` the words before each.
    """
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    none = np.zeros(0, np.int64)
    if not len(values):
        return none, none, none, none
    # words of different documents are made to differ
    values = textcore.mix(values ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    last = before[1:][doc]
    levels, needed = _ranks(values, last)
    at = np.flatnonzero(needed)
    if not len(at):
        return none, none, none, none
    places = at[np.argsort(levels[-1][at], kind="stable")]
    common = np.zeros(len(places), np.int64)
    common[1:] = _common(levels, places[:-1], places[1:], last)
    left = np.full(len(values), -1, np.int64)
    left[1:] = levels[0][:-1]
    left[before[:-1][n > 0]] = -1  # nothing stands before a document's first word
    del levels
    got = np.array(list(_pairs(places.tolist(), common.tolist(), left.tolist())), np.int64).reshape(-1, 3)
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    got = got[~_same_as_before(got[:, 0], got[:, 1])]  # a multiple of a run's period has the same ends
    got = got[np.lexsort((got[:, 2], got[:, 0]))]
    own = doc[got[:, 0]]
    return own, got[:, 0] - before[own], got[:, 1], got[:, 2]


def _collapsed(data, start, end, dropped, before) -> pa.Array:
    """Every document's words that aren't dropped, joined by one space."""
    kept = ~dropped
    size = np.where(kept, end - start + 1, 0)  # each with the space after it
    wide = np.append(data, np.uint8(32))
    index = textcore.take_ranges(start[kept], size[kept])
    space = np.cumsum(size[kept]) - 1
    index[space] = len(data)
    text = wide[index]
    ends = np.concatenate([[0], np.cumsum(size)])[before]
    # without each document's last space
    has = np.diff(ends) > 0
    solid = np.ones(len(text), bool)
    solid[ends[1:][has] - 1] = False
    offsets = ends - np.concatenate([[0], np.cumsum(has)])
    return pa.Array.from_buffers(pa.large_string(), len(before) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text[solid]))])


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", reorder: Callable[[pa.Array, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, n_words, runs array<struct<start,length,period>> by start and period, collapsed) of every whole text.

    ``collapsed`` has the words joined by one space, without those that lie in a run after its first period.
    ``reorder`` (keys, words before each document) gives the word that is read at each place, so that other
    word orders than the text's own can be looked at; without it the text's own.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                keys = batch.column(0).slice(a, b - a)
                start, end, before = textcore.words(part, at)
                if reorder is not None:
                    place = reorder(keys, before)
                    start, end = start[place], end[place]
                doc, first, length, period = find_runs(textcore.span_hash(textcore.prefix_hash(part), start, end), before)
                shift = np.zeros(len(start) + 1, np.int64)
                np.add.at(shift, before[doc] + first + period, 1)
                np.add.at(shift, before[doc] + first + length, -1)
                counts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (first, length, period)], ["start", "length", "period"])
                collapsed = _collapsed(part, start, end, np.cumsum(shift)[:-1] > 0, before)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(before), pa.int64()), pa.ListArray.from_arrays(pa.array(counts), runs).cast(_RUNS), collapsed.cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the longest run (ties: smallest start, then period), and digests of ``detect``'s rows."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.withColumn("_best", best)
    length = -F.col("_best.less")
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"), F.col("_best.period").alias("period"),
        F.expr("-1000 * _best.less div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
