"""Token-ID files: patched frame-of-reference blocks.

A file is a sequence of segments, each complete in itself. A segment holds the ids of consecutive
documents, in ascending key order, cut into blocks of ``BLOCK`` ids that pay no regard to documents. A
block subtracts its minimum, packs every value at the width that holds ``PERCENTILE`` per cent of its
values, and stores the higher bits of the rest in an exception list. The segment's index gives each
block's byte start, so a reader reaches any block alone.

Segment layout, little-endian:
    magic b"PFR1", u32 n_docs, u64 n_ids, u32 n_blocks, u64 segment bytes (all of it)
    i64 key per document, u64 ids per document
    u64 byte start per block, counted from the first block
    blocks: u32 minimum, u8 width, u16 exceptions, packed values (most significant bit first, padded
    to a byte), u16 position per exception, u32 high bits per exception
Spark's text writer puts the files in place, with its task commit, on whatever store the path names; it
ends each segment with one line-feed byte, which the reader skips.

Defined results: a null or empty text has only the end id; repeated keys are kept, in no fixed order
among themselves; an empty table has no files to read and gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.llm import textcore
from docmill.llm.shared import fresh_folder
from docmill.llm.wordbpe import LibraryEncoder, default_path, encoder

BLOCK = 512
PERCENTILE = 90
#: Ids after which a segment is closed; bounds the memory of writer and reader.
SEGMENT_IDS = 2_000_000
#: Text bytes that one file is made from, about; a file is read as a whole.
FILE_TEXT_BYTES = 16 << 20
MAGIC = b"PFR1"
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4"), ("bytes", "<u8")])
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "<u2")])


def _lane(width: int) -> int:
    """Bytes of the smallest whole number that holds so many bits."""
    return 1 if width <= 8 else 2 if width <= 16 else 4


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes."""
    lane = _lane(width)
    bits = np.unpackbits(rows.astype(f">u{lane}").view(np.uint8).reshape(*rows.shape, lane), axis=2)[:, :, 8 * lane - width :]
    return np.packbits(bits.reshape(len(rows), -1), axis=1)


def _unpack(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    lane = _lane(width)
    bits = np.unpackbits(rows, axis=1)[:, : n * width].reshape(len(rows), n, width)
    full = np.zeros((len(rows), n, 8 * lane), np.uint8)
    full[:, :, 8 * lane - width :] = bits
    return np.packbits(full, axis=2).reshape(len(rows), -1).view(f">u{lane}").astype(np.uint32)


def write_segment(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    parts: list[bytes] = [b""] * blocks
    for rows, first in ((ids[: n // BLOCK * BLOCK].reshape(-1, BLOCK), 0), (ids[n // BLOCK * BLOCK :].reshape(1, -1), n // BLOCK)):
        if not rows.size:
            continue
        low = rows.min(axis=1)
        value = rows - low[:, None]
        k = min(rows.shape[1] - 1, rows.shape[1] * PERCENTILE // 100)
        width = np.frexp(np.partition(value, k, axis=1)[:, k].astype(np.float64))[1]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            packed = _pack(value[own] & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(own), 0), np.uint8)
            high = value[own] >> np.uint32(w) if w < 32 else np.zeros_like(value[own])
            at, where = np.nonzero(high)
            bound = np.searchsorted(at, np.arange(len(own) + 1))
            heads = np.zeros(len(own), _BLOCK_HEAD)
            heads["low"], heads["width"], heads["patches"] = low[own], w, np.diff(bound)
            # as bytes at once, to be cut by block
            head, body, place, rest = heads.tobytes(), packed.tobytes(), where.astype("<u2").tobytes(), high[at, where].astype("<u4").tobytes()
            h, p = _BLOCK_HEAD.itemsize, packed.shape[1]
            for j, (r, i, e) in enumerate(zip(own.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
                parts[first + r] = b"".join((head[h * j : h * j + h], body[p * j : p * j + p], place[2 * i : 2 * e], rest[4 * i : 4 * e]))
    starts = np.cumsum([0, *map(len, parts)])
    index = keys.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + starts[:-1].astype("<u8").tobytes()
    head = np.array((MAGIC, len(keys), n, blocks, _HEAD.itemsize + len(index) + int(starts[-1])), _HEAD)
    return b"".join((head.tobytes(), index, *parts))


class Segment:
    """Reads one segment; ``ids(i, j)`` decodes only the blocks that hold the ids i .. j-1."""

    def __init__(self, raw: memoryview):
        head = np.frombuffer(raw, _HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n, blocks = int(head["docs"]), int(head["ids"]), int(head["blocks"])
        at = _HEAD.itemsize
        self.keys = np.frombuffer(raw, "<i8", docs, at)
        self.counts = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.starts = np.frombuffer(raw, "<u8", blocks, at + 16 * docs).astype(np.int64)
        self.first = at + 16 * docs + 8 * blocks
        self.raw = np.frombuffer(raw, np.uint8)
        self.bytes = int(head["bytes"])

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n if end is None else end
        if end <= begin:
            return np.zeros(0, np.uint32)
        blocks = np.arange(begin // BLOCK, -(-end // BLOCK))
        size = np.minimum(BLOCK, self.n - blocks * BLOCK)
        at = self.first + self.starts[blocks]
        heads = self.raw[at[:, None] + np.arange(_BLOCK_HEAD.itemsize)].reshape(-1).view(_BLOCK_HEAD)
        out = np.zeros((len(blocks), BLOCK), np.uint32)
        for n in np.unique(size):
            for w in np.unique(heads["width"][size == n]):
                own = np.flatnonzero((size == n) & (heads["width"] == w))
                length = -(-int(n) * int(w) // 8)
                body = at[own] + _BLOCK_HEAD.itemsize
                if w:
                    out[own, :n] = _unpack(self.raw[body[:, None] + np.arange(length)], int(w), int(n))
                patches = heads["patches"][own].astype(np.int64)
                row = np.repeat(own, patches)
                where = textcore.take_ranges(body + length, 2 * patches)
                place = self.raw[where].view("<u2")
                high = self.raw[textcore.take_ranges(body + length + 2 * patches, 4 * patches)].view("<u4")
                out[row, place] |= (high.astype(np.uint64) << np.uint64(w)).astype(np.uint32)
        out += heads["low"][:, None]
        flat = out.reshape(-1)[: int(size.sum())] if len(blocks) else out.reshape(-1)
        return flat[begin - blocks[0] * BLOCK : end - blocks[0] * BLOCK]


def segments(raw: bytes) -> Iterator[Segment]:
    view, at = memoryview(raw), 0
    while at < len(view):
        segment = Segment(view[at:])
        yield segment
        at += segment.bytes + 1  # the writer's line feed


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encodes every whole text, appends ``end_id``, and writes token files in ascending key order.

    One range shuffle of the texts by key; the number of files follows their bytes. A task's ids go out a
    segment at a time. Rows with a null key come first.
    """
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(max(1, -(-total // FILE_TEXT_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(LibraryEncoder, tokenizer)
        end = np.array([end_id], np.uint32)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            raw = write_segment(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["segment"])

        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            for a, b in textcore.steps(offsets):
                ids, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), end[0])
                held.append((keys[a:b], counts + 1, ids))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield segment()
                    held, size = [], 0
        if held:
            yield segment()

    dealt = rows.repartitionByRange(files, "key").sortWithinPartitions("key") if files > 1 else rows.coalesce(1).sortWithinPartitions("key")
    dealt.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, segment, place, key, n_tokens, ids_crc32, first): a row per document, a task per few files.

    ``first`` counts the ids before the document within its file; ``ids_crc32`` is that of the ids as
    little-endian unsigned 32-bit integers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for s in segments(content.as_buffer()):
                    raw = s.ids().astype("<u4")
                    at = np.concatenate([[0], np.cumsum(s.counts)])
                    crc = np.array([zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(s.keys)), pa.array(s.keys), pa.array(s.counts), pa.array(crc), pa.array(before + at[:-1])], names=["file", "key", "n_tokens", "ids_crc32", "first"])
                    before += s.n

    return files.mapInArrow(run, "file string, key long, n_tokens long, ids_crc32 long, first long")


def token_file_digests(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes token files, reads them back, and returns key, start, n_tokens, ids_crc32 per document.

    ``start`` counts the ids of all documents before; it is the document's place in its file plus the ids
    of all files before, a sum over one row per file.
    """
    spark = docs.sparkSession
    path = path or fresh_folder(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id, text, key)
    rows = read_token_files(spark, path)
    rows = rows.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    index = fresh_folder(spark, "token-index")
    rows.write.parquet(index)  # a small row per document, so that the files are decoded once
    rows = spark.read.schema(rows.schema).parquet(index)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids")).withColumn("before", F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)))
    out = rows.join(files.select("file", F.coalesce("before", F.lit(0)).alias("before")), "file")
    return out.select(F.when(F.col("key") != F.lit(-(2**63)), F.col("key")).alias(key), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
