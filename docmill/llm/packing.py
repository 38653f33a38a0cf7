"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest unpacked piece that fits, again and again. When none fits, the
bin's smallest piece may give way to two unpacked pieces that together fill the expanded gap more
tightly. Pieces are dealt round-robin to groups of about ``GROUP`` pieces, one task each; a group leaves
about one loose bin, so the loss against one global packing is about one sequence in a thousand.

Defined results: a null or empty text is a piece with the end id alone; repeated rows are packed one by
one; a document is cut only if it alone exceeds a sequence; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.shared import written
from docmill.llm.wordbpe import LibraryEncoder, default_path, encoder

CAPACITY = 4096
GROUP = 16_384


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into ``lengths``; every length is from 0 to ``capacity``."""
    stock: dict[int, list[int]] = {}
    for k in np.argsort(lengths, kind="stable")[::-1]:
        stock.setdefault(int(lengths[k]), []).append(int(k))
    there = 0  # bit x: a piece of length x is unpacked
    for x in stock:
        there |= 1 << x

    def largest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(x: int) -> int:
        nonlocal there
        got = stock[x].pop()
        if not stock[x]:
            there &= ~(1 << x)
        return got

    bins = []
    while there:
        gap, own, sizes = capacity, [], []
        while (x := largest(gap)) >= 0:
            own.append(take(x))
            sizes.append(x)
            gap -= x
        if gap and there:
            small = sizes[-1]  # greedy filling takes pieces in descending order
            room, best, pair = small + gap, small, None
            a = largest(room // 2)
            while a >= 0:
                b = largest(room - a)
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1) if a else -1
                if b >= 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1) if a else -1
            if pair:
                put_back = own.pop()
                own += [take(pair[0]), take(pair[1])]
                stock.setdefault(small, []).append(put_back)
                there |= 1 << small
        bins.append(own)
    return bins


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every whole text's ids and end id, cut only beyond ``capacity``."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(LibraryEncoder, path)
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets):
                ids, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                counts = counts + 1
                first = np.cumsum(counts) - counts
                n = -(-counts // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = first[row] + start
                crc = [zlib.crc32(raw[i : i + k]) for i, k in zip(at, length, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to ``capacity``.

    The rows must be stored (not computed anew by each action), since they are counted first. Dealing is
    round-robin over sorted rows, so a lost task that runs again gets the same rows.
    """
    n = pieces.count()
    groups = max(1, -(-n // group))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        used = 0

        def packed() -> pa.RecordBatch:
            nonlocal used
            table = pa.Table.from_batches(held).combine_chunks()
            size = table.column(length).to_numpy()
            bins = best_two_fit(size, capacity)
            order = np.fromiter((k for own in bins for k in own), np.int64, len(size))
            number = np.repeat(np.arange(len(bins)), [len(own) for own in bins])
            run_sum = np.cumsum(size[order]) - size[order]
            first = np.concatenate([[True], number[1:] != number[:-1]])
            offset = run_sum - np.repeat(run_sum[first], np.diff(np.append(np.flatnonzero(first), len(number))))
            out = table.take(pa.array(order)).append_column("sequence_id", pa.array(base + used + number)).append_column("offset", pa.array(offset))
            used += len(bins)
            return out.select(names).combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            if sum(len(x) for x in held) >= 2 * group:
                yield packed()
                held = []
        if sum(len(x) for x in held):
            yield packed()

    dealt = pieces.repartition(groups) if groups > 1 else pieces.coalesce(1)
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, text, key), "pieces"), capacity)
