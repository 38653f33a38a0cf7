"""Exact removal of repeated passages by prefix-free parsing: dictionary order and parse order combined.

**Parse.** A rolling hash over ``GRAM`` bytes is tested at every place; a place that passes (one in
``MODULUS``) is a trigger, and a phrase runs from one trigger to the next. A string of ``length`` bytes
belongs to the first trigger among its first ``REACH`` places. Long phrases are bounded by one rule that
reads nothing but the string itself: where none of these places passes, the place of least hash is the
trigger. So equal strings always have equal triggers at one distance d, whatever stands around them.

**Dictionary and parse.** A string is the last d bytes of the phrase that leads to its trigger (a dictionary
suffix) followed by what the parse holds from the trigger on (a parse prefix). Phrase and continuation make
a *context*; equal contexts are one from the start, so a passage that stands in a million documents is a
few contexts with a count, and what occurs twice in one context repeats without any comparison. For the
rest, the different phrases of a range get their rank in the order from their ends (suffix order of the
dictionary), the different continuations their rank in the order from their starts (suffix order of the
parse); common prefixes of neighbours in both orders give, for each d, the classes of equal dictionary
suffixes and equal parse prefixes, and a string repeats when its pair of classes holds two contexts.

**At scale.** The corpus order is never in one place: a range of it holds the contexts with one ``KEY``-byte
continuation, and equal strings are always in one range. Triggers whose continuation occurs once leave
after one aggregation on an 8-byte key; bitmaps of bounded size keep most of what has no partner, texts too, out of
the shuffles that follow, and results never depend on them. A range of more than ``RANGE_ROWS`` contexts is cut in two by d, and
each half is keyed by all bytes that its strings have in common, again and again: halves that agree in
full are counted, halves that agree with nothing leave, and the others get smaller. Texts are read in
blocks, so a long text takes no more memory than its own bytes and a block.

Defined results: null text is empty; equal texts of at least ``length`` bytes lose every byte; texts
shorter than ``length`` lose none; matches never cross documents; repeated rows (key and text) are equal
texts; null keys take part; an empty table gives no rows; columns of any other name are let alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore, wordwindows
from docmill.llm.shared import bounded_batches, free_names, hash_filter, may_have, may_pass, written

LENGTH = 400
GRAM = 16
#: One place in so many passes the hash test.
MODULUS = 48
#: A string's trigger lies among so many of its first places.
REACH = 96
#: Bytes from a trigger on that all contexts of a range have in common.
KEY = 160
#: Bytes of text that one vectorised step handles; longer texts are cut into steps of this size.
STEP = 1 << 18
#: Contexts that one ordering task holds, about, and those of one range from which it is cut by d.
TASK_ROWS = 16_000
RANGE_ROWS = 2_000
#: Contexts that a scanning task remembers having sent with their bytes.
REMEMBERED = 1 << 18
_SECOND_BASE = 0x2545F4914F6CDD1D


class Parser:
    """Finds triggers and the strings that belong to them."""

    def __init__(self, length: int = LENGTH):
        self.gram = min(GRAM, max(1, length // 8))
        self.length, self.reach = length, min(REACH, max(1, (length - self.gram) // 2))
        self.key = min(KEY, length - self.reach + 1)
        self.wide = length - self.key  # bytes after the key that the string of d = 0 has
        self.limit = np.uint64((1 << 32) // MODULUS << 32)

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Block]:
        """All triggers with strings, block by block: whole texts together, a long text in pieces whose
        borders depend on the text alone."""
        for a, b in textcore.steps(offsets, STEP):
            sizes = np.diff(offsets[a : b + 1])
            if b - a == 1 and sizes[0] > STEP:
                last = int(sizes[0]) - self.length + 1  # starts there are
                for s in range(0, last, STEP):
                    yield Block(self, data, int(offsets[a]) + s, np.array([min(STEP, last - s)]), np.array([min(STEP, last - s) + self.length - 1]), a, s)
            else:
                yield Block(self, data, int(offsets[a]), np.maximum(0, sizes - self.length + 1), sizes, a, 0)


class Block:
    """The triggers of one block: ``place``, ``first`` and ``last`` string start within the block's bytes,
    ``doc`` the row of the batch, ``at`` the place within the text."""

    def __init__(self, parser: Parser, data: np.ndarray, begin: int, starts: np.ndarray, sizes: np.ndarray, row: int, shift: int):
        self.parser, total = parser, int(sizes.sum())
        self.data = d = data[begin : begin + total]
        empty = np.zeros(0, np.int64)
        self.place = self.first = self.last = self.doc = self.at = empty
        if total < parser.length or not starts.any():
            return
        self.prefix = textcore.prefix_hash(d)
        low = (self.prefix[parser.gram :] - self.prefix[: -parser.gram]) * textcore.powers(textcore._BASE, total)[: total - parser.gram + 1]
        low *= np.uint64(0x9E3779B97F4A7C15)
        low[low < parser.limit] = 0  # these places pass the test, and the first of them is the least
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(low), dtype=np.uint64)
        span = 1
        while 2 * span <= parser.reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < parser.reach:
            low = np.minimum(low[: -(parser.reach - span)], low[parser.reach - span :])
        begins = np.cumsum(sizes) - sizes
        start = textcore.take_ranges(begins, starts)
        doc = np.repeat(np.arange(len(sizes)), starts)
        place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del low
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        self.place, self.first, self.last, self.doc = place[new], start[new], start[np.append(new[1:], len(place)) - 1], row + doc[new]
        self.at = self.place - begins[doc[new]] + shift

    def keys(self) -> np.ndarray:
        return textcore.span_hash(self.prefix, self.place, self.place + self.parser.key) if len(self.place) else np.zeros(0, np.uint64)


def second_prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textcore._BYTE_CODE[255 - data] * textcore.powers(pow(_SECOND_BASE, -1, 1 << 64), len(data)), out=out[1:])
    return out


def second_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return textcore.mix((prefix[end] - prefix[start]) * textcore.powers(_SECOND_BASE, len(prefix))[start])


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _scan(parser: Parser):
    """Per document: digest, key, n_bytes, n_chars, and the 8-byte keys of its triggers' continuations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            n = len(batch)
            doc, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for block in parser.blocks(data, offsets):
                doc.append(block.doc)
                keys.append(block.keys())
            at = 8 * np.searchsorted(np.concatenate(doc), np.arange(n + 1))
            digest = b"".join(hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True))
            chars = [int(np.count_nonzero((data[i:j] & 0xC0) != 0x80)) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [_binary(digest, np.arange(0, 32 * n + 1, 32)), batch.column(0), pa.array(np.diff(offsets)), pa.array(chars, pa.int64()), _binary(np.concatenate(keys).tobytes(), at)],
                names=["digest", "key", "n_bytes", "n_chars", "keys"],
            )

    return run


def _exploded(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of the batch, number within the row) of all triggers."""
    data, offsets = textcore.flat_text(keys)
    per = np.diff(offsets) // 8
    return np.frombuffer(data.tobytes(), np.int64), np.repeat(np.arange(len(per)), per), np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's different keys, with 63 bits of its text's digest and, as the lowest bit, whether it has the key
    twice. So copies of one text say the same, and a key stands twice if its values differ or are odd."""
    for batch in batches:
        k, row, _ = _exploded(batch.column(1))
        order = np.argsort(k.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal ones lie together
        first = np.flatnonzero(np.append(True, (k[order[1:]] != k[order[:-1]]) | (row[order[1:]] != row[order[:-1]]))[: len(k)])
        again = np.full(len(k), -1)  # rows leave text by text, which packs better
        again[order[first]] = np.diff(np.append(first, len(k))) > 1
        own = np.flatnonzero(again >= 0)
        name = np.frombuffer(textcore.flat_text(batch.column(0))[0].tobytes(), "<i8").reshape(-1, 4)[:, 0] & ~1
        yield pa.RecordBatch.from_arrays([pa.array(k[own]), pa.array(name[row[own]] | again[own])], names=["k", "v"])


def _candidates(keys, tids):
    """The triggers whose key and document the two bitmaps can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_have(tids, batch.column(0).to_numpy())))
            k, row, idx = _exploded(batch.column(1))
            ok = may_have(keys, k)
            yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(batch.column(0).to_numpy()[row[ok]]), pa.array(idx[ok].astype(np.int32))], names=["k", "tid", "idx"])

    return run


_RECORD = "c long, c2 long, k long, k2 long, tid long, t int, low short, high short, left binary, right binary"


def _contexts(parser: Parser):
    """The contexts of the wanted triggers; only the first of a task's equal contexts has its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            tids, lists = batch.column(0).to_numpy(), batch.column(2)
            wanted = lists.flatten().to_numpy()
            cut = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            before = np.zeros(len(batch), np.int64)  # triggers of a text in blocks that went before
            for block in parser.blocks(data, offsets):
                rows, count = np.unique(block.doc, return_counts=True)
                if not len(rows):
                    continue
                own = []
                begin = np.searchsorted(block.doc, rows)
                for r, i, n in zip(rows, begin, count, strict=True):
                    w = wanted[cut[r] : cut[r + 1]] - before[r]
                    own.append(i + np.sort(w[(w >= 0) & (w < n)]))
                before[rows] += count
                own = np.concatenate(own)
                if not len(own):
                    continue
                t, first, last = block.place[own], block.first[own], block.last[own]
                left, right = t - first, last + parser.length - t - parser.key
                other = second_prefix(block.data)
                where = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                c = textcore.mix(textcore.span_hash(block.prefix, first, last + parser.length) ^ where)
                c2 = textcore.mix(second_hash(other, first, last + parser.length) ^ where)
                _, at = np.unique(c, return_index=True)
                fresh = np.zeros(len(c), bool)
                fresh[at] = True
                if len(sent):
                    fresh &= sent[np.minimum(np.searchsorted(sent, c), len(sent) - 1)] != c
                sent = np.union1d(sent, c[fresh]) if len(sent) < REMEMBERED else np.sort(c[fresh])
                ends = lambda start, n: _slices(block.data, start[fresh], n[fresh], fresh)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x.view(np.int64)) for x in (c, c2, textcore.span_hash(block.prefix, t, t + parser.key), second_hash(other, t, t + parser.key))),
                        pa.array(tids[block.doc[own]]), pa.array(block.at[own].astype(np.int32)), pa.array((t - last).astype(np.int16)), pa.array(left.astype(np.int16)),
                        ends(first, left), ends(t + parser.key, right),
                    ],
                    names=["c", "c2", "k", "k2", "tid", "t", "low", "high", "left", "right"],
                )

    return run


def _slices(data: np.ndarray, start: np.ndarray, length: np.ndarray, there: np.ndarray) -> pa.Array:
    """The byte ranges, at the rows that are there; null elsewhere."""
    size = np.zeros(len(there), np.int64)
    size[there] = length
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    nulls = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(there), [nulls, pa.py_buffer(at), pa.py_buffer(data[textcore.take_ranges(start, length)])])


def _padded(column: pa.Array, width: int, at_end: bool) -> np.ndarray:
    """Rows of bytes; ``at_end`` puts the last byte first, so that rows compare from their ends."""
    data, offsets = textcore.flat_text(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out[row, np.repeat(size, size) - 1 - col if at_end else col] = data
    return out


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows in order, rank of each row)."""
    if rows.shape[1] == 0:
        return rows[:1], np.zeros(len(rows), np.int64)
    _, first, rank = np.unique(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return rows[first], rank


def _order(group: np.ndarray, rank: np.ndarray, different: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (group, rank), and the common prefix of each with the one before (-1: another group)."""
    order = np.lexsort((rank, group))
    g, r = group[order], rank[order]
    common = np.full(len(order), -1, np.int64)
    inner = np.flatnonzero(g[1:] == g[:-1]) + 1
    same = different[r[inner]] == different[r[inner - 1]]
    common[inner] = np.where(same.all(axis=1), different.shape[1], same.argmin(axis=1) if different.shape[1] else 0)
    return order, common


def repeated(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, d) of the strings that two rows have, among rows whose group tells equal keys.

    Row r has the strings of low[r] <= d <= high[r]: the last d bytes of its phrase (``left``, reversed)
    and its continuation (``right``) up to ``wide - d`` bytes beyond the key.
    """
    phrases, phrase = ranked(left)
    suffixes, suffix = ranked(right)
    by_left, common_left = _order(group, phrase, phrases)
    by_right, common_right = _order(group, suffix, suffixes)
    n = len(group)
    most = lambda order, common: _scatter(order, np.maximum(common, np.append(common[1:], -1)), n)
    far_left, far_right = most(by_left, common_left), most(by_right, common_right)
    # a string can repeat only if d bytes agree to the left and the rest to the right with some row
    first, last = np.maximum(low, wide - far_right), np.minimum(high, far_left)
    rows, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    may = np.flatnonzero(first <= last)
    for d in range(int(first[may].min()), int(last[may].max()) + 1) if len(may) else ():
        live = may[(first[may] <= d) & (d <= last[may])]
        if len(live) < 2:
            continue
        a = _scatter(by_left, np.cumsum(common_left < d), n)[live]
        b = _scatter(by_right, np.cumsum(common_right < wide - d), n)[live]
        pair = a.astype(np.int64) * (n + 1) + b
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        rows.append(live[order[twice]])
        ds.append(np.full(int(twice.sum()), d))
    return np.concatenate(rows), np.concatenate(ds)


def _scatter(order: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    out[order] = values
    return out


_FOUND = "c long, c2 long, low int, high int"


def _match(parser: Parser):
    """Of all contexts of a task (its ranges are whole): runs of d whose strings another context has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        c, c2, k, k2, low, high = (table.column(x).to_numpy() for x in ("c", "c2", "k", "k2", "low", "high"))
        order = np.lexsort((c2, c, k2, k))
        differ = lambda *cols: np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in cols], axis=0)])
        own = order[differ(k, k2, c, c2)]  # several tasks may have sent one context
        group = _scatter(order, np.cumsum(differ(k, k2)), len(k))[own]
        own, group = own[np.bincount(group)[group] > 1], group[np.bincount(group)[group] > 1]
        if len(own) < 2:
            return
        side = lambda name, width, at_end: _padded(table.column(name).combine_chunks().take(pa.array(own)), width, at_end)
        row, d = repeated(group, low[own].astype(np.int64), high[own].astype(np.int64), side("left", parser.reach, True), side("right", parser.wide, False), parser.wide)
        order = np.lexsort((d, row))
        row, d = row[order], d[order]
        if not len(row):
            return
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (d[1:] != d[:-1] + 1)]))
        last = np.append(new[1:], len(row)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(c[own[row[new]]]), pa.array(c2[own[row[new]]]), pa.array(d[new].astype(np.int32)), pa.array(d[last].astype(np.int32))], names=["c", "c2", "low", "high"])

    return run


def _cut_ranges(parser: Parser, rows: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(contexts in ranges of at most ``most`` rows, runs of d found on the way) of contexts in large ranges.

    Each round halves the d of a range. The strings of a half have in common the last d0 bytes of the phrase
    and the first ``wide - d1`` bytes after the key: that is the half's own key. Contexts that agree in all
    that their strings of this half hold are counted, and one of them goes on for the others.
    """
    rows = rows.select("c", "c2", "k", "k2", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "left", "right", F.lit(0).alias("d0"), F.lit(parser.reach - 1).alias("d1"))
    small, found = None, None
    plus = lambda a, b: b if a is None else a.unionByName(b)
    suffix = lambda n: F.substring("left", F.octet_length("left") - n + 1, n)
    while rows.head(1):
        middle = F.floor((F.col("d0") + F.col("d1")) / 2).cast("int")
        halves = F.array(F.struct(F.col("d0").alias("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("d1").alias("y")))
        rows = rows.withColumn("half", F.explode(halves)).withColumn("d0", F.col("half.x")).withColumn("d1", F.col("half.y")).drop("half").where("d0 <= d1 and d0 <= high and d1 >= low")
        rows = rows.withColumn("low", F.greatest("low", "d0")).withColumn("high", F.least("high", "d1"))
        common = [suffix(F.col("d0")), F.substring("right", F.lit(1), F.lit(parser.wide) - F.col("d1"))]
        whole = [suffix(F.col("high")), F.substring("right", F.lit(1), F.lit(parser.wide) - F.col("low")), "low", "high"]
        rows = rows.withColumns({f"q{s or ''}": F.xxhash64(F.lit(s), "k", "k2", "d0", *common) for s in (0, 2)} | {f"p{s or ''}": F.xxhash64(F.lit(s), "k", "k2", "d0", *whole) for s in (0, 2)})
        rows = written(rows, "halves")
        contents = rows.groupBy("q", "q2", "p", "p2").agg(F.count("*").alias("n"), F.min(F.struct("c", "c2")).alias("one"))
        contents = written(contents, "contents")
        sizes = contents.groupBy("q", "q2").agg(F.count("*").alias("m"))
        found = plus(found, rows.join(contents.where("n > 1").select("p", "p2"), ["p", "p2"]).select("c", "c2", "low", "high"))
        left = contents.join(sizes.where("m > 1"), ["q", "q2"]).select("p", "p2", F.col("one.c").alias("c"), F.col("one.c2").alias("c2"), "m")
        left = rows.join(left, ["p", "p2", "c", "c2"]).select(F.col("q").alias("k"), F.col("q2").alias("k2"), "c", "c2", "low", "high", "left", "right", "d0", "d1", "m")
        left = written(left, "ranges")
        small = plus(small, left.where(F.col("m") <= most).drop("m", "d0", "d1"))
        rows = left.where(F.col("m") > most).drop("m")
    return small, found


def _merge_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            runs = lists.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            a, b = runs.field("a").to_numpy().astype(np.int64), runs.field("b").to_numpy().astype(np.int64) + length
            order = np.lexsort((a, row))
            row, a, b = row[order], a[order] + (row[order] << 33), b[order] + (row[order] << 33)
            reach = np.maximum.accumulate(b)
            new = np.concatenate([[True], (a[1:] > reach[:-1]) | (row[1:] != row[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            own = row[first]
            pairs = np.stack([a[first] - (own << 33), reach[last] - (own << 33)], axis=1).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(pairs.tobytes(), 8 * np.searchsorted(own, np.arange(len(batch) + 1)))], names=["tid", "spans"])

    return run


def _at(column: str = "key") -> Column:
    """The key for joins; null counts as the least number."""
    return F.coalesce(column, F.lit(-(2**63)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", most: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): rows has a row per document (digest, key, n_bytes, n_chars, tid); texts one per
    different text (tid, digest, key of one holder, n_bytes, copies, elsewhere: whether a stretch of ``KEY``
    bytes at a trigger stands in another text too); spans the removed runs of texts (tid, spans as pairs of
    little-endian 32-bit integers), without those that go as a whole for having copies."""
    bounded_batches(docs.sparkSession)
    parser = Parser(length)
    source = _source(docs, text, key)
    # the triggers' keys are stored once, with the documents; what is shuffled of a text is told by a number
    rows = source.mapInArrow(_scan(parser), "digest binary, key long, n_bytes long, n_chars long, keys binary")
    rows = written(rows.withColumn("tid", F.monotonically_increasing_id()), "parsed")
    texts = written(rows.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.min("tid").alias("tid")), "texts")

    keyed = rows.where(F.octet_length("keys") > 0)
    twice = keyed.select("digest", "keys").mapInArrow(_holders, "k long, v long").groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    twice = twice.where("a <> b or a % 2 <> 0").select("k", (F.shiftright("a", 1) != F.shiftright("b", 1)).alias("elsewhere"))
    twice = written(twice, "repeated")  # a plain scan, so that Spark can split a skewed join with it
    triggers = keyed.select("tid", "keys").mapInArrow(_candidates(_bits(twice, "k"), _bits(texts, "tid")), "k long, tid long, idx int")
    wanted = triggers.join(twice, "k").groupBy("tid").agg(F.collect_list("idx").alias("idx"), F.max("elsewhere").alias("elsewhere"))
    wanted = written(wanted.join(texts.select("tid", "digest", _at().alias("at")), "tid"), "wanted")
    # by key and digest, so that copies of one text don't meet
    full = _among(source, wanted).join(wanted, ["digest", "at"])
    records = written(full.select("tid", "text", "idx").mapInArrow(_contexts(parser), _RECORD), "contexts")

    seen = written(records.groupBy("k", "k2", "c", "c2").agg(F.count("*").alias("n")), "counts")
    several = written(seen.groupBy("k", "k2").agg(F.count("*").alias("m")).where("m > 1"), "several")
    large = written(several.where(F.col("m") > most).select("k", "k2"), "large")
    found = seen.where("n > 1").select("c", "c2", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    bodies = records.where("left is not null").select("c", "c2", "k", "k2", "low", "high", "left", "right")
    compared = may_pass(bodies, "k", _bits(several, "k"))  # a context alone in its range needs no shuffle
    if large.head(1):
        big = bodies.join(large, ["k", "k2"], "left_semi").dropDuplicates(["c", "c2"])
        small, more = _cut_ranges(parser, big, most)
        bodies, compared = (x.join(large, ["k", "k2"], "left_anti").unionByName(small) for x in (bodies, compared))
        found = found.unionByName(more)
    tasks = max(1, -(-bodies.count() // TASK_ROWS))
    found = found.unionByName(compared.repartition(tasks, "k").mapInArrow(_match(parser), _FOUND))
    hits = records.select("c", "c2", "tid", "t", F.col("low").alias("least"), F.col("high").alias("largest")).join(written(found, "found"), ["c", "c2"])
    runs = hits.select("tid", F.struct((F.col("t") - F.coalesce("high", "largest")).alias("a"), (F.col("t") - F.coalesce("low", "least")).alias("b")).alias("s"))
    spans = written(runs.groupBy("tid").agg(F.collect_list("s").alias("s")).mapInArrow(_merge_spans(length), "tid long, spans binary"), "spans")
    texts = texts.join(wanted.select("tid", "elsewhere"), "tid", "left")
    return rows.drop("keys"), texts, spans


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _bits(df: DataFrame, column: str):
    """A bitmap of the column's values, of a size that fits a stored table."""
    return hash_filter(df, column, df.count())


def _among(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, at, digest) of the documents that may be those of ``wanted``, by their key: others need no shuffle, nor a
    digest."""
    place = F.xxhash64("at").alias("place")
    rows = may_pass(source.select("text", _at().alias("at")).select("text", "at", place), "place", _bits(wanted.select(place), "place"))
    return rows.select("text", "at", F.unhex(F.sha2("text", 256)).alias("digest"))


def _cut(text: bytes, spans: bytes) -> bytes:
    at = np.frombuffer(spans, "<i4").reshape(-1, 2)
    ends = np.concatenate([[0], at[:, 1]])
    starts = np.concatenate([at[:, 0], [len(text)]])
    return b"".join(text[i:j] for i, j in zip(ends, starts, strict=True))


def _digest_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        kept = [_cut(t, s) for t, s in zip(texts, spans, strict=True)]
        numbers = [len(t) - len(k) for t, k in zip(texts, kept, strict=True)], [len(s) // 8 for s in spans], [len(k.decode("utf-8", "ignore")) for k in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array([hashlib.sha256(k).digest() for k in kept], pa.binary())],
            names=["digest", "n_removed", "n_spans", "kept_chars", "kept"],
        )


def removal_digests(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every document; then n_chars (whole characters of
    what is kept) and repeats_elsewhere (bytes were removed, or a stretch of ``KEY`` bytes at a trigger, which
    may be shorter than what is removed, stands in another text too)."""
    rows, texts, spans = repeated_spans(docs, length, text, key)
    enough = F.col("n_bytes") >= length
    partial = written(texts.where((F.col("copies") == 1) & enough).select("tid", "digest", _at().alias("at")).join(spans, "tid").drop("tid"), "partial")
    cut = _among(_source(docs, text, key), partial).join(partial, ["digest", "at"]).select("digest", "text", "spans").mapInArrow(_digest_cut, "digest binary, n_removed long, n_spans long, kept_chars long, kept binary")
    zero = F.lit(0).cast("long")
    whole = texts.where((F.col("copies") > 1) & enough).select("digest", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), zero.alias("kept_chars"), F.unhex(F.sha2(F.lit(""), 256)).alias("kept"))
    near = texts.where("elsewhere").select("digest", F.lit(True).alias("elsewhere"))
    out = rows.join(cut.unionByName(whole).join(near, "digest", "full"), "digest", "left")
    return out.select(
        F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"),
        F.coalesce("kept_chars", "n_chars").alias("n_chars"), (F.coalesce("elsewhere", F.lit(False)) | F.coalesce(F.col("n_removed") > 0, F.lit(False))).alias("repeats_elsewhere"),
    )


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one text from several sources as one; an empty one stands for the whole text."""
    for batch in batches:
        out = []
        for parts in batch.column(1).to_pylist():
            at = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2)
            if len(parts) > 1 and all(parts):
                at = at[np.argsort(at[:, 0], kind="stable")]
                reach = np.maximum.accumulate(at[:, 1])
                first = np.flatnonzero(np.append(True, at[1:, 0] > reach[:-1]))
                at = np.stack([at[first, 0], reach[np.append(first[1:], len(at)) - 1]], axis=1)
            out.append(at.astype("<i4").tobytes() if all(parts) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["digest", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """The documents without the bytes that repeated strings cover, with all their columns.

    Repeated are strings of ``length`` bytes and, where ``words`` is given, also stretches of so many words
    (``wordwindows``), from the first one's start to the last one's end, which may have fewer bytes. Both are judged
    on the input. Of a character that is cut through nothing stays. ``n_chars``, if there, follows the new text. A
    document of which nothing but white space is left goes; one that was so before stays.
    """
    _, texts, spans = repeated_spans(docs, length, text, key)
    partial = texts.where((F.col("copies") == 1) & (F.col("n_bytes") >= length)).join(spans, "tid").select("digest", "spans")
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("digest", F.lit(b"").alias("spans"))
    spans = partial.unionByName(whole)
    digest, cut, place = free_names(docs, "digest", "spans", "place")
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)))
    if words is not None:
        named = marked.select(F.col(digest).alias("digest"), F.col(text).cast("string").alias("text"))
        windows = wordwindows.repeated_windows(named, words)
        if windows is not None:
            more = windows.mapInArrow(_merge_spans(0), "tid binary, spans binary").toDF("digest", "spans")
            spans = spans.unionByName(more).groupBy("digest").agg(F.collect_list("spans").alias("spans")).mapInArrow(_unite, "digest binary, spans binary")
    # texts from which nothing goes need no shuffle
    spans = written(spans.toDF(digest, cut).withColumn(place, F.xxhash64(digest)), "removed")
    marked, rest = marked.withColumn(place, F.xxhash64(digest)), docs
    if n := spans.count():
        bits = hash_filter(spans, place, n)
        marked, rest = may_pass(marked, place, bits), may_pass(marked, place, bits, keep=False).select(*docs.columns)
        marked = marked.drop(place).join(spans.drop(place), digest, "left").select(*docs.columns, cut)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at), batch.column(len(batch.schema) - 1)
            out, kept = [], []
            for k in range(len(batch)):
                raw, cut = texts[k].as_py(), spans[k].as_py()
                new = raw if cut is None else _cut(raw.encode(), cut).decode("utf-8", "ignore") if cut else ""
                out.append(new)
                kept.append(cut is None or bool(new.strip()))
            columns = [pa.array(out, texts.type) if i == at else batch.column(i) for i in range(len(batch.schema) - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(kept, pa.bool_()))

    out = marked.mapInArrow(run, docs.schema).unionAll(rest) if n else rest
    if "n_chars" in docs.columns and text != "n_chars":
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
