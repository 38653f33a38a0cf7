"""Sets of word shingles as sorted arrays of 64-bit hashes, for whole batches of documents at once."""

from __future__ import annotations

import numpy as np

from docmill.llm import textcore

SIZE = 5
#: Bytes of text that one vectorised step handles.
STEP = 1 << 19
_ODD = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(16)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): every document's distinct shingles, sorted by hash within the document.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document with fewer than ``size`` words
    has its whole sequence as its one shingle, and none without words. Without ``distinct``, all shingles in
    text order.
    """
    text = textcore.lower_ascii(data)
    start, end, before = textcore.words(text, offsets)
    word = textcore.span_hash(textcore.prefix_hash(text), start, end)
    count = np.diff(before)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), n)
    at = textcore.take_ranges(before[:-1], n)
    have = count[doc]  # words there are for a shingle of this document
    got = np.zeros(len(at), np.uint64)
    for k in range(size):
        more = have > k  # a short document's shingle ends with its last word
        part = word[np.minimum(at + k, max(0, len(word) - 1))] if len(word) else got
        got = np.where(more, textcore.mix(got + part * np.uint64(_ODD[k])), got)
    if not distinct:
        return got, np.concatenate([[0], np.cumsum(n)])
    order = np.lexsort((got, doc))
    got, doc = got[order], doc[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
    return got[new], np.searchsorted(doc[new], np.arange(len(count) + 1))
