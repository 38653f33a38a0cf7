"""Collocations: phrases of two to four words that occur together far more often than their parts do.

**Counting.** Words of a document are counted first, then pairs of frequent words, then phrases of three and
four words whose every pair is frequent; a phrase can't be more frequent than a part of it, so nothing is
lost. Each task counts in a HAT-trie (``HatTrie``): a trie over word ids whose leaves are hash tables of the
phrases' further words; a table that grows too large bursts into a node with a table for every next word.
When a task holds too many phrases, whole subtrees, the largest first, leave as runs sorted by their
words. Runs meet by prefix, the first word (and for words that make up much of the corpus by a part of what
follows), and are added up there.

**Filters.** Which words and pairs are frequent is told to the tasks by a bitmap of bounded size. It lets
some others through, which are counted in vain and dropped afterwards; results never depend on it.

**Scores.** Parts of a phrase are looked up by joins, each cut is scored in exact decimals, and the lowest
counts. The first phrases of each group are found by score before their texts are fetched.

A-Z is lower-cased, ``[.,;:!?\\x0A-\\x0D]`` ends a piece, words are ``[^\\x20\\x09]+`` of a piece. Words are told apart by
64-bit hashes (with 10^9 words of which 10^7 are frequent, the chance that any frequent word is mixed up with
another is 1 in 2,000). Defined results: a null or empty text has no words; a null group is ``und``;
repeated rows count each time; equal scores and counts go by the phrase's bytes; an empty table, or one
without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.llm import textcore
from docmill.llm.shared import bounded_batches, filter_place, hash_filter, written

MIN_COUNT = 30
MOST_WORDS = 4
TOP = 2000
#: A longer phrase with at least so many percent of a phrase's occurrences takes its place.
COVER_PERCENT = 80
UNKNOWN = "und"
#: Phrases that one task's trie holds before subtrees leave, and the size at which a hash table bursts.
HELD = 1 << 19
BURST = 1 << 12
#: Bits of a word's id in a packed key, and how many ids there are before a trie is emptied.
ID_BITS = 21
#: Bytes of text that one vectorised step handles.
STEP = 1 << 21
#: Words that make up at least one in so many of all (so no more than these) have their runs dealt to PARTS places.
HEAVY, PARTS = 1024, 64
#: Phrases that one step of a merging task handles, beyond the prefix that it is at.
MERGED = 1 << 18

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_PLAIN[_ENDS] = 32
_WORDS = tuple(f"w{k + 1}" for k in range(MOST_WORDS))


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, document, piece) of all words: text is lower-cased, with piece ends as spaces; words of
    one piece have one piece number."""
    text = _PLAIN[data]
    start, end, before = textcore.words(text, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDS[data], out=ends[1:])
    return text, start, end, doc, ends[start] + doc


class HatTrie:
    """Counts of phrases: a trie over word ids with hash tables as leaves.

    The root has a child for every first id; a child is a table from packed further ids to counts, or, once
    burst, a node with a table for every second id. An id is a word's number in ``ids``.
    """

    def __init__(self, held: int, burst: int):
        self.held, self.burst = held, burst
        self.clear()

    def clear(self) -> None:
        self.root: dict[int, dict] = {}
        self.nodes: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.size = 0
        self.ids: dict[int, int] = {}
        self.words: list[int] = []

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Ids (from 1) of word hashes; new ones get the next number."""
        distinct, where = np.unique(hashes, return_inverse=True)
        ids, words = self.ids, self.words
        out = []
        for h in distinct.tolist():
            i = ids.get(h)
            if i is None:
                words.append(h)
                i = ids[h] = len(words)
            out.append(i)
        return np.array(out, np.int64)[where] if out else np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return self.size > self.held or len(self.words) > (1 << ID_BITS) - (1 << 18)

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Counts phrases, given by their first id (with a group's number above it) and the packed others."""
        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(first))).tolist()
        first, rest = first[at], rest[at]
        cut = np.flatnonzero(np.append(True, first[1:] != first[:-1])).tolist()
        heads, rest = first[cut].tolist(), rest.tolist()
        low = 2 * ID_BITS
        for head, a, b in zip(heads, cut, [*cut[1:], len(rest)], strict=True):
            table = self.root.get(head)
            if table is None:
                self.root[head] = dict(zip(rest[a:b], count[a:b], strict=True))
                self.sizes[head] = b - a
                self.size += b - a
                continue
            grown = 0
            if head in self.nodes:
                for r, c in zip(rest[a:b], count[a:b], strict=True):
                    own = table.setdefault(r >> low, {})
                    r &= (1 << low) - 1
                    grown += r not in own
                    own[r] = own.get(r, 0) + c
            else:
                had = len(table)
                own = rest[a:b]
                table.update(zip(own, map(add, count[a:b], map(table.get, own, repeat(0))), strict=True))
                grown = len(table) - had
                if len(table) > self.burst:
                    self._burst(head, table)
            self.sizes[head] += grown
            self.size += grown

    def _burst(self, head: int, table: dict[int, int]) -> None:
        low = 2 * ID_BITS
        node: dict[int, dict[int, int]] = {}
        for r, c in table.items():
            node.setdefault(r >> low, {})[r & ((1 << low) - 1)] = c
        self.root[head] = node
        self.nodes.add(head)

    def spill(self, all_: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, rest, count) of whole subtrees in no order: the largest until half is left, or all."""
        if all_:
            gone = list(self.root)
        else:
            gone, left = [], self.size
            for head in sorted(self.root, key=self.sizes.__getitem__, reverse=True):
                if left <= self.held // 2:
                    break
                gone.append(head)
                left -= self.sizes[head]
        low = 2 * ID_BITS
        plain = [head for head in gone if head not in self.nodes]
        leaves = [(head, above << low, table) for head in gone if head in self.nodes for above, table in self.root[head].items()]
        tables = [self.root[head] for head in plain] + [table for _, _, table in leaves]
        sizes = np.array([len(t) for t in tables], np.int64)
        total = int(sizes.sum())
        first = np.repeat(np.array(plain + [head for head, _, _ in leaves], np.int64), sizes)
        rest = np.fromiter(chain.from_iterable(tables), np.int64, total)
        rest |= np.repeat(np.array([0] * len(plain) + [above for _, above, _ in leaves], np.int64), sizes)
        count = np.fromiter(chain.from_iterable(t.values() for t in tables), np.int64, total)
        for head in gone:
            self.size -= self.sizes.pop(head)
            del self.root[head]
            self.nodes.discard(head)
        return first, rest, count


def _pair_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of word hashes as one number, for filters; ``_pair_column`` is the same as a column."""
    return ((a << np.uint64(1)) | (a >> np.uint64(63))) ^ b


def _pair_column(a: str, b: str) -> Column:
    return F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(F.col(b))


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = filter_place(ids.view(np.int64), 8 * len(bits))
    return ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)


def _grouped(docs: DataFrame, text: str, group: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))


def count_words(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    """(lang, word, w1, n): how often each word occurs in each group; w1 is the word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            number = langs.indices.to_numpy().astype(np.int64)
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                raw, start, end, doc, _ = piece_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(start):
                    continue
                flat = raw[textcore.take_ranges(start, end - start)]
                at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
                found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
                key, n = np.unique(number[a:b][doc] * len(found.dictionary) + found.indices.to_numpy(), return_counts=True)
                words = found.dictionary.take(pa.array(key % len(found.dictionary)))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // len(found.dictionary))), words.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            h = textcore.span_hash(textcore.prefix_hash(data), offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h.view(np.int64)), batch.column(2)], names=["lang", "word", "w1", "n"])

    counted = _grouped(docs, text, group).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(hashed, "lang string, word string, w1 long, n long")


def count_phrases(docs: DataFrame, words: DataFrame, pairs: DataFrame | None = None, text: str = "text", group: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, w1 .. w4, a): phrases that occur ``min_count`` times or more, as word hashes; absent words are 0.

    Pairs of the frequent words (``words`` has w1 and n), or with frequent ``pairs`` (w1, w2) the phrases of three and four
    words whose pairs are all among them."""
    word_bits = hash_filter(words, "w1", words.count())
    pair_bits = hash_filter(pairs.select(_pair_column("w1", "w2").alias("id")), "id", pairs.count()) if pairs is not None else None
    low, mask = ID_BITS, (1 << ID_BITS) - 1
    short = pairs is None
    columns = ["lang", "w1", "part", *(_WORDS[1:2] if short else _WORDS[1:]), "n"]
    total = words.agg(F.sum("n")).first()[0] or 0  # of the frequent words, which are all that is counted
    heavy = np.array([r["w1"] for r in words.where(F.col("n") * HEAVY >= total).select("w1").distinct().collect()], np.int64).view(np.uint64)  # HEAVY at most

    def emptied(trie: HatTrie, names: list[str], all_: bool) -> Iterator[pa.RecordBatch]:
        """Subtrees as sorted runs: a row for each first word (and part, of a heavy one) with the other words' hashes."""
        first, rest, count = trie.spill(all_)
        known = np.array([0, *trie.words], np.uint64)  # id 0: no word
        ids = [known[(rest >> (low * k)) & mask] for k in (2, 1, 0)][: 1 if short else 3]
        part = np.where(np.isin(known[first & mask], heavy), (textcore.mix(sum(w * np.uint64(2 * k + 3) for k, w in enumerate(ids))) >> np.uint64(58)).astype(np.int64), 0)
        order = np.lexsort((rest, part, first))
        first, part, count, ids = first[order], part[order], count[order], [w[order] for w in ids]
        cut = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (part[1:] != part[:-1]))) if len(first) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(first))
        for a, b in textcore.steps(np.append(cut, len(first)), 1 << 16):
            lo, hi = cut[a], ends[b - 1]
            at = pa.py_buffer((8 * (np.append(cut[a:b], hi) - lo)).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), b - a, [None, at, pa.py_buffer(np.ascontiguousarray(x[lo:hi]))]) for x in (*ids, count)]
            head = first[cut[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(head >> low)), pa.array(known[head & mask].view(np.int64)), pa.array(part[cut[a:b]], pa.int32()), *packed], names=columns)

    def phrases(hashes: np.ndarray, piece: np.ndarray, bits, more) -> Iterator[tuple[np.ndarray, int]]:
        """(places, length): where phrases of the length begin that may be frequent."""
        ok = _passes(bits, hashes)
        together = ok[:-1] & ok[1:] & (piece[:-1] == piece[1:])
        if more is None:
            yield np.flatnonzero(together), 2
            return
        together &= _passes(more, _pair_id(hashes[:-1], hashes[1:]))
        three = together[:-1] & together[1:]
        yield np.flatnonzero(three), 3
        yield np.flatnonzero(three[:-1] & together[2:]), 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names, number = HatTrie(HELD, BURST), [], {}
        bits, more = word_bits.value, pair_bits.value if pair_bits is not None else None
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for name in langs.dictionary.to_pylist():
                if name not in number:
                    number[name] = len(names)
                    names.append(name)
            lang = np.array([number[x] for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                raw, start, end, doc, piece = piece_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(start) < 2:
                    continue
                hashes = textcore.span_hash(textcore.prefix_hash(raw), start, end)
                found = list(phrases(hashes, piece, bits, more))
                used = np.zeros(len(hashes), bool)
                for at, length in found:
                    for k in range(length):
                        used[at + k] = True
                if trie.full or used.sum() > (1 << ID_BITS) - len(trie.words) - 1:
                    fresh = len(trie.words) + used.sum() >= (1 << ID_BITS) - (1 << 18)
                    yield from emptied(trie, names, bool(fresh))
                    if fresh:
                        trie.clear()
                ids = np.zeros(len(hashes), np.int64)
                ids[used] = trie.number(hashes[used])
                for at, length in found:
                    rest = np.zeros(len(at), np.int64)
                    for k in range(1, length):
                        rest |= ids[at + k] << (low * (MOST_WORDS - 1 - k))
                    trie.add((lang[a:b][doc[at]] << low) | ids[at], rest)
        yield from emptied(trie, names, True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one prefix, next to each other, added up."""
        held: list[pa.RecordBatch] = []
        size, end = 0, None
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            fresh = np.append(end is None or tuple(k[0] for k in keys) != end, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            end = tuple(k[-1] for k in keys)
            last = np.flatnonzero(fresh)
            if len(last) and size > MERGED:
                yield _added(held + [batch.slice(0, last[-1])], min_count)
                held, size = [], 0
                batch = batch.slice(last[-1])
            held.append(batch)
            size += batch.nbytes // 16
        if held:
            yield _added(held, min_count)

    rest = columns[3:]
    runs = _grouped(docs, text, group).mapInArrow(run, "lang string, w1 long, part int, " + ", ".join(f"{c} binary" for c in rest))
    met = runs.repartition("lang", "w1", "part").sortWithinPartitions("lang", "w1", "part")
    return met.mapInArrow(merge, "lang string, " + ", ".join(f"{w} long" for w in _WORDS) + ", a long")


def _added(runs: list[pa.RecordBatch], min_count: int) -> pa.RecordBatch:
    """(lang, w1 .. w4, a) of phrases with ``min_count`` occurrences or more in runs, those of one prefix next to each other."""
    table = pa.Table.from_batches(runs).combine_chunks()
    column = lambda name: table.column(name).chunk(0) if len(table) else pa.array([], pa.binary())
    langs = table.column("lang").combine_chunks().dictionary_encode()
    head = [langs.indices.to_numpy(zero_copy_only=False), *(table.column(c).to_numpy() for c in ("w1", "part"))]
    flat, offsets = textcore.flat_text(column("n"))
    sizes = np.diff(offsets) // 8
    row = np.repeat(np.arange(len(table)), sizes)
    number = np.cumsum(np.append(False, np.logical_or.reduce([h[1:] != h[:-1] for h in head]))) if len(table) else np.zeros(0, np.int64)
    words = [np.frombuffer(textcore.flat_text(column(w))[0].tobytes(), np.int64) for w in _WORDS[1:] if w in table.column_names]
    count = np.frombuffer(flat.tobytes(), np.int64)
    order = np.lexsort((*reversed(words), number[row])) if len(count) else np.zeros(0, np.int64)
    keys = [number[row][order], *(w[order] for w in words)]
    fresh = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))) if len(count) else np.zeros(0, np.int64)
    sums = np.add.reduceat(count[order], fresh) if len(fresh) else count
    kept = fresh[sums >= min_count]
    at = row[order][kept]
    made = [w[order][kept] for w in words]
    made += [np.zeros(len(kept), np.int64)] * (MOST_WORDS - 1 - len(made))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(head[0][at])), pa.array(head[1][at], pa.int64()), *(pa.array(w) for w in made), pa.array(sums[sums >= min_count])], names=["lang", *_WORDS, "a"])


def _cut(words: list[str], a: int, b: int) -> list[Column]:
    """Words a .. b - 1 as the columns of a phrase."""
    own = [F.col(w) for w in words[a:b]]
    return [*own, *[F.lit(0).cast("long")] * (MOST_WORDS - len(own))]


def _parts(spans) -> Column:
    """array<struct<k, w1 .. w4>> of (condition, k, from, to)."""
    made = [F.when(when, F.struct(F.lit(k).alias("k"), *(c.alias(w) for c, w in zip(_cut(list(_WORDS), a, b), _WORDS, strict=True)))) for when, k, a, b in spans]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def score_phrases(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1 .. w4, a, score, l, r): each phrase's lowest-scoring cut, ties to the earliest."""
    key = ["lang", *_WORDS]
    size = sum((F.col(w) != 0).cast("int") for w in _WORDS)
    known = phrases.select(*key, F.col("a").alias("f")).unionByName(words.select("lang", "w1", *(F.lit(0).cast("long").alias(w) for w in _WORDS[1:]), F.col("n").alias("f")))
    # side 2 * k is what stands before the cut after k words, 2 * k + 1 what follows
    spans = [(size == n, 2 * k + side, *((0, k) if side == 0 else (k, n))) for n in range(2, MOST_WORDS + 1) for k in range(1, n) for side in (0, 1)]
    exploded = phrases.select(*(F.col(c).alias(f"_{c}") for c in key), "a", "lang", F.explode(_parts(spans)).alias("p")).select("*", "p.*").drop("p")
    sides = {s: F.max(F.when(F.col("k") == s, F.col("f"))) for s in range(2, 2 * MOST_WORDS)}
    found = exploded.join(known, key).groupBy(*(f"_{c}" for c in key)).agg(F.first("a").alias("a"), *(v.alias(f"s{s}") for s, v in sides.items()))
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, MOST_WORDS):
        l, r = F.col(f"s{2 * k}"), F.col(f"s{2 * k + 1}")
        score = F.call_function("div", wide(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), wide(l) + wide(r))
        cuts.append(F.when(l.isNotNull() & r.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    best = F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull()))
    return found.select(*(F.col(f"_{c}").alias(c) for c in key), "a", best.alias("b")).select(*key, "a", "b.score", "b.l", "b.r")


def drop_covered(scored: DataFrame, phrases: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """The scored phrases that stand in no longer phrase with at least ``percent`` of their occurrences."""
    key = ["lang", *_WORDS]
    size = sum((F.col(w) != 0).cast("int") for w in _WORDS)
    spans = [(size == n, 0, a, a + m) for n in range(3, MOST_WORDS + 1) for m in range(2, n) for a in range(n - m + 1)]
    inner = phrases.where(size > 2).select("lang", "a", F.explode(_parts(spans)).alias("p")).select("lang", "a", "p.*")
    most = inner.groupBy(*key).agg(F.max("a").alias("longer"))
    wide = lambda c: c.cast("decimal(20,0)")
    covered = wide(F.col("longer")) * 100 >= wide(F.col("a")) * percent
    return scored.join(most, key, "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each group (named lang here) by score."""
    words = written(count_words(docs, text, group), "words")
    frequent = words.where(F.col("n") >= min_count)
    pairs = written(count_phrases(docs, frequent, None, text, group, min_count), "pairs")
    longer = written(count_phrases(docs, frequent, pairs, text, group, min_count), "longer")
    phrases = pairs.unionByName(longer)
    left = drop_covered(score_phrases(phrases, frequent), phrases)
    # those that can be among the first, ties at the end included; the texts decide between them
    close = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = written(left.withColumn("_place", F.rank().over(close)).where(F.col("_place") <= top).drop("_place"), "best")
    for w in _WORDS:
        best = best.join(frequent.select("lang", F.col("w1").alias(w), F.col("word").alias(f"_{w}")), ["lang", w], "left")
    phrase = F.concat_ws(" ", *(f"_{w}" for w in _WORDS))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    made = best.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    final = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = made.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
