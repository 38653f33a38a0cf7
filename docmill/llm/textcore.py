"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on one Arrow batch at a time: the UTF-8 bytes of many documents lie in one
flat ``uint8`` array with an offset per document, so a step costs a few numpy passes per byte
instead of Python work per document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

def _return_freed_memory() -> None:
    """Large arrays go back to the system when freed: a worker lives on from task to task, and what the
    allocators would keep for later adds up to more than any one task needs."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library: memory is kept longer, results are the same
        pass


_return_freed_memory()

#: Bytes of text that one vectorised step handles; bounds a worker's memory whatever the batch holds.
STEP_BYTES = 1 << 20

SPACE, LETTER, DIGIT, PUNCT, APOSTROPHE, OTHER = range(6)

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[:128] = PUNCT
_CLASS[list(b" \t\n\x0b\x0c\r")] = SPACE
_CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[ord("'")] = APOSTROPHE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers); works in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        raise TypeError(f"text or binary expected, not {column.type}")
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, n + 1, column.offset * width().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer single text is a range of its own)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] = sum of code(byte k) * base**-k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(_INVERSE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span [start, end), independent of where it lies; lengths are mixed in."""
    got = (prefix[end] - prefix[start]) * powers(_BASE, len(prefix))[start]
    return mix(got + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each document) of the words ``[^\\x20\\x09-\\x0D]+`` of every document."""
    solid = _CLASS[data] != SPACE
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    start = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, .. start[i]+length[i]-1 for all i, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return shift + np.arange(total)


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """SPACE .. OTHER for every byte; both bytes of a Latin-1 letter (U+00C0 to U+00FF without the signs) are LETTER."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    return kind


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Cuts documents into units that a white-space-dropping word tokenizer treats independently.

    A unit never spans white space, and two units meet only where such a tokenizer ends a piece in any
    case: between ASCII letters (or Latin-1 letters), ASCII digits and ASCII punctuation. No cut is made
    next to an apostrophe (contractions) or next to any other character (it may combine or merge).
    Letters are lower-cased unless a character that could combine with them follows. Returns the units,
    dictionary-encoded, and the number of units before each document.
    """
    kind = byte_kinds(data)
    text = _LOWER[data]
    if len(data):
        text[1:] += 32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)).astype(np.uint8)
    other = np.flatnonzero(kind == OTHER)
    if len(other):  # a mark may combine with the letter before it: leave that letter as it is
        before = other[other > 0] - 1
        text[before] = data[before]
    solid = kind != SPACE
    cut = solid.copy()
    if len(data) > 1:
        a, b = kind[:-1], kind[1:]
        free = (a != APOSTROPHE) & (b != APOSTROPHE) & (a != OTHER) & (b != OTHER)
        cut[1:] &= (a == SPACE) | (free & ((a != b) | (a == DIGIT)))
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        cut[inner] = solid[inner]
    start = np.flatnonzero(cut)
    kept = text[solid]
    rank = np.cumsum(solid) - solid
    at = np.append(rank[start], len(kept)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return array.dictionary_encode(), np.searchsorted(start, offsets)
