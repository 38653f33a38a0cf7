"""Quality rules: base counts of words, symbols and repeats, and compression bands.

The method's verdict comes from zstandard ratios (compressed bytes over bytes): of the whole text, within
a band for its length, and of fixed chunks, of which most must lie in the chunk band. A low ratio tells
repetitive text, a high one incompressible text (keys, encoded data). Short texts compress less, so bands
depend on length; texts below the first band's length are judged by the base rules alone.

Defined results: null or empty text has no words and fails the base rules; repeated rows are judged
alike; an empty table gives no rows. Rows stay in their partitions: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.shared import bounded_batches

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: (bytes from, lowest ratio, highest ratio) for whole texts.
#: The highest lie between clean text (of any script) and base64 at these lengths.
BANDS = (
    (128, 0.32, 1.02), (192, 0.32, 0.93), (256, 0.32, 0.89), (384, 0.32, 0.82), (512, 0.30, 0.78), (1024, 0.30, 0.74),
    (2048, 0.28, 0.70), (16384, 0.24, 0.70), (131072, 0.20, 0.70),
)
CHUNK = 1024
#: Lowest and highest ratio of a chunk, and the share of a text's chunks that may lie outside.
CHUNK_BAND = (0.32, 0.75)
CHUNK_SHARE = 0.25
LEVEL = 3
#: Bytes of text that one vectorised step handles.
STEP = 1 << 19


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each row in that order equals the one before) by owner and value."""
    order = np.lexsort((value, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    return order, same


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every document."""
    docs = len(offsets) - 1
    prefix = textcore.prefix_hash(data)
    start, end, before = textcore.words(data, offsets)
    n_words = np.diff(before)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    of_word = np.repeat(np.arange(docs), n_words)
    word_chars = np.bincount(of_word, points[end] - points[start], docs).astype(np.int64)
    wanted = np.zeros(256, bool)
    wanted[list(SYMBOLS)] = True
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(wanted[data], out=symbols[1:])

    # lines: they start at a document's start and after each line feed, and end before the next
    feeds = np.flatnonzero(data == 10)
    inside = np.searchsorted(offsets, feeds, "right") - 1
    line_start = np.concatenate([offsets[:-1], feeds + 1])
    line_doc = np.concatenate([np.arange(docs), inside])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.append(line_start[1:] - 1, 0)
    last = np.append(line_doc[1:] != line_doc[:-1], True) if len(line_doc) else np.zeros(0, bool)
    line_end[last] = offsets[1:][line_doc[last]]
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    order, same = _repeats(line_doc, textcore.span_hash(prefix, line_start, line_end))
    n_dup_lines = np.bincount(line_doc[order[same]], minlength=docs)

    # windows of three words that stand twice or more, and the words that any of them covers
    word = textcore.span_hash(prefix, start, end)
    windows = np.maximum(0, n_words - 2)
    at = textcore.take_ranges(before[:-1], windows)
    window_doc = np.repeat(np.arange(docs), windows)
    key = textcore.mix(word[at] * np.uint64(3) + textcore.mix(word[at + 1] * np.uint64(5) + textcore.mix(word[at + 2] * np.uint64(7)))) if len(at) else np.zeros(0, np.uint64)
    order, same = _repeats(window_doc, key)
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = at[order[twice]]
    covered = np.zeros(len(start), bool)
    for k in range(3):
        covered[hit + k] = True
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(of_word[covered], minlength=docs),
    }


def compression(data: np.ndarray, offsets: np.ndarray, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """(ratio of the whole text, share of chunks outside the chunk band) of every document. The last
    chunk ends where the text ends, so that every byte is judged in a chunk of full size."""
    tool = zstandard.ZstdCompressor(level=level)
    view = memoryview(np.ascontiguousarray(data))
    n = np.diff(offsets)
    whole = np.ones(len(n))
    odd = np.zeros(len(n))
    for k, (a, size) in enumerate(zip(offsets[:-1].tolist(), n.tolist(), strict=True)):
        if size < BANDS[0][0]:
            continue
        whole[k] = len(tool.compress(view[a : a + size])) / size
        if size >= CHUNK:
            starts = [*range(a, a + size - CHUNK, CHUNK), a + size - CHUNK]
            ratio = np.array([len(tool.compress(view[i : i + CHUNK])) / CHUNK for i in starts])
            odd[k] = np.mean((ratio < CHUNK_BAND[0]) | (ratio > CHUNK_BAND[1]))
    return whole, odd


def in_bands(n_bytes: np.ndarray, whole: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The method's verdict: the whole ratio is in its length's band and enough chunks are in theirs."""
    band = np.searchsorted([b[0] for b in BANDS], n_bytes, "right") - 1
    low = np.array([b[1] for b in BANDS])[np.maximum(band, 0)]
    high = np.array([b[2] for b in BANDS])[np.maximum(band, 0)]
    return (band < 0) | ((whole >= low) & (whole <= high) & (odd <= CHUNK_SHARE))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in _NAMES) + ", base_failed boolean, kept boolean, ratio double, odd_chunks double"


def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of SCHEMA for one step of documents."""
    out = base_counts(data, offsets)
    whole, odd = compression(data, offsets)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & in_bands(np.diff(offsets), whole, odd), "ratio": whole, "odd_chunks": odd}


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the counts and verdicts of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                got = judge(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(v) for v in got.values())], names=[key, *got])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(at))
            for a, b in textcore.steps(offsets, STEP):
                kept = judge(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])["kept"]
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
