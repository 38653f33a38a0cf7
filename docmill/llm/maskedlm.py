"""Masked pseudo-likelihood: a window network predicts every word from both sides.

The network reads the ``SIDE`` words before and after a place, never the word itself: embeddings, one tanh
layer, and a softmax over classes times a softmax within the class. Words are the ``VOCABULARY`` most
frequent of the whole corpus, counted over all documents; every other word is one of ``BUCKETS`` hash
buckets, of whose probability it has its share by its count (all words never counted share one count more).
Shares of at most ``KNOWN`` of the most frequent such words go to every task, those of all others come by a join. A document's score is the sum of the conditional log-probabilities of all its words.

Training is data-parallel numpy: in each of ``ROUNDS`` rounds every task starts from the shared
parameters, takes Adagrad steps over every ``STRIDE``-th place of all its documents (other places in other
rounds, so that every place is learnt once), and sends its parameters in blocks, which are averaged by places learnt from. What is gathered so
grows with the corpus; only one averaged parameter set reaches the driver.

Defined results: null or empty text and text without words has no words, a sum of 0 and no mean; repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.shared import bounded_batches, free_names, written

SIDE = 2
CLASSES = 32
VOCABULARY = 1024 - 64
BUCKETS = 64  # a power of two
KNOWN = 1 << 16
#: Logarithms are summed as whole numbers of this fraction, so that no order of rows changes a sum.
FINE = float(1 << 32)
WIDTH = 16
HIDDEN = 32
ROUNDS = 2
#: As many as rounds: each round takes its own places, all rounds together take all.
STRIDE = ROUNDS
BATCH = 2048
#: Places scored in one numpy step; arrays of so many stay in the processor's cache.
SCORED = 1 << 12
RATE = 0.1
STEP = 1 << 19
#: Places of the parameters that are averaged as one row.
BLOCK = 1 << 13


class Network:
    """Parameters in one flat float32 vector, with views for each layer. Word 0 pads the edges of a text."""

    def __init__(self, words: int, flat: np.ndarray | None = None):
        #: (word, n) of all words outside the vocabulary and the buckets' totals, on the driver.
        self.rare: tuple[DataFrame, list[int]] | None = None
        self.per_class = -(-words // CLASSES)
        shapes = {
            "embed": (words + 1, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,),
            "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ws": (CLASSES, HIDDEN, self.per_class), "bs": (CLASSES, self.per_class),
        }
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat
        at = np.cumsum([0, *sizes])
        for k, (name, shape) in enumerate(shapes.items()):
            setattr(self, name, self.flat[at[k] : at[k + 1]].reshape(shape))

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small fixed random weights; output biases give each word its share of the corpus."""
        net = cls(len(counts))
        draw = np.random.default_rng(7)
        net.embed[1:] = draw.normal(0, 0.1, net.embed[1:].shape)
        net.w[:] = draw.normal(0, 1 / np.sqrt(len(net.w)), net.w.shape)
        share = np.full(CLASSES * net.per_class, 1e-6)
        share[: len(counts)] += counts / max(1.0, counts.sum())
        share = share.reshape(CLASSES, -1)
        net.bc[:] = np.log(share.sum(axis=1) / share.sum())
        net.bs[:] = np.log(share / share.sum(axis=1, keepdims=True))
        return net

    def steep(self) -> tuple[bool, np.ndarray]:
        """Whether the weights would let a logit be too large for exp (inputs lie in -1 .. 1): for the classes,
        and for the words of each class."""
        within = (np.abs(self.ws).sum(axis=1) + np.abs(self.bs)).max(axis=1) > 80
        return bool((np.abs(self.wc).sum(axis=0) + np.abs(self.bc)).max() > 80), within

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed.take(around.ravel(), axis=0).reshape(len(around), -1)
        h = x @ self.w
        h += self.b
        return x, np.tanh(h, out=h)

    def log_probability(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log P(word | words around) of each place; words count from 0."""
        parts = np.matmul(self.embed, self.w.reshape(2 * SIDE, WIDTH, HIDDEN))  # of each word on each seat
        h = parts[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += parts[k].take(around[:, k], axis=0)
        h += self.b
        np.tanh(h, out=h)
        c, s = word // self.per_class, word % self.per_class
        steep, steep_within = self.steep()
        z, e, total = _softmax(self.wc.T @ h.T, self.bc, steep)
        out = z[c, np.arange(len(word))] - np.log(total)
        order, cuts = _by_class(c)
        h, s = h.take(order, axis=0), s[order]
        within = np.empty(len(word), z.dtype)
        for k, i, j in cuts:
            z, e, total = _softmax(self.ws[k].T @ h[i:j].T, self.bs[k], steep_within[k])
            within[i:j] = z[s[i:j], np.arange(j - i)] - np.log(total)
        out[order] += within
        return out

    def learn(self, around: np.ndarray, word: np.ndarray, memory: Network) -> None:
        """One Adagrad step on the mean log-probability of the batch."""
        n = len(word)
        x, h = self.hidden(around)
        c, s = word // self.per_class, word % self.per_class
        grad = Network(len(self.embed) - 1)
        steep, steep_within = self.steep()
        _, gc, total = _softmax(self.wc.T @ h.T, self.bc, steep)
        gc /= total
        gc[c, np.arange(n)] -= 1
        grad.wc[:], grad.bc[:] = (gc @ h).T, gc.sum(axis=1)
        order, cuts = _by_class(c)
        x, h, s, gc = x.take(order, axis=0), h.take(order, axis=0), s[order], gc.take(order, axis=1)
        gh = gc.T @ self.wc.T
        for k, i, j in cuts:
            _, gs, total = _softmax(self.ws[k].T @ h[i:j].T, self.bs[k], steep_within[k])
            gs /= total
            gs[s[i:j], np.arange(j - i)] -= 1
            grad.ws[k], grad.bs[k] = (gs @ h[i:j]).T, gs.sum(axis=1)
            gh[i:j] += gs.T @ self.ws[k].T
        gz = gh * (1 - h * h)
        grad.w[:], grad.b[:] = x.T @ gz, gz.sum(axis=0)
        gx = (gz @ self.w.T).reshape(n * 2 * SIDE, WIDTH)
        seat = around.take(order, axis=0).ravel()
        for k in range(WIDTH):
            grad.embed[:, k] = np.bincount(seat, gx[:, k], len(grad.embed))
        grad.embed[0] = 0
        g = grad.flat / n
        memory.flat += g * g
        self.flat -= RATE * g / (np.sqrt(memory.flat) + 1e-6)


def _softmax(z: np.ndarray, bias: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits with their bias, exp of them, sums of those) in columns, since numpy goes through all places at
    once then. The largest logit is taken off where one could be too large for exp."""
    z += bias[:, None]
    if steep:
        z -= z.max(axis=0)
    e = np.exp(z)
    return z, e, e.sum(axis=0)


def _by_class(c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of places by class, (class, from, to) of each class that occurs)."""
    order = np.argsort(c.astype(np.uint8), kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=CLASSES))])
    return order, [(k, int(cut[k]), int(cut[k + 1])) for k in range(CLASSES) if cut[k] < cut[k + 1]]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word after lower-casing A-Z, words before each document)."""
    text = textcore.lower_ascii(data)
    start, end, before = textcore.words(text, offsets)
    return textcore.span_hash(textcore.prefix_hash(text), start, end), before


def word_numbers(hashes: np.ndarray, vocabulary: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Words as numbers: those of the (sorted) vocabulary, else the vocabulary's size plus a bucket."""
    bucket = len(vocabulary) + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    if not len(vocabulary):
        return bucket
    # the first word of the vocabulary with the same leading bits, and those after it with them
    lead = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    begin = np.searchsorted(vocabulary, lead)
    at = begin[(hashes >> np.uint64(48)).astype(np.int64)]
    out = bucket
    for k in range(int(np.diff(np.append(begin, len(vocabulary))).max())):
        near = np.minimum(at + k, len(vocabulary) - 1)
        out = np.where(vocabulary[near] == hashes, number[near], out)
    return out


def windows(words: np.ndarray, before: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The words (plus 1; 0 beyond the text's edges) around each place."""
    doc = np.searchsorted(before, places, "right") - 1
    shift = np.array([d for d in range(-SIDE, SIDE + 1) if d])
    at = places[:, None] + shift
    ok = (at >= before[doc][:, None]) & (at < before[doc + 1][:, None])
    return np.where(ok, words[np.clip(at, 0, max(0, len(words) - 1))] + 1, 0)


def turn_places(turn: int, rounds: int, stride: int, n: int) -> np.ndarray:
    """The places among n that a round learns from."""
    return np.arange((turn * stride // max(1, rounds)) % stride, n, stride)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word long, n): every word's count over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(0))
            for a, b in textcore.steps(offsets, STEP):
                held.append(word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0])
                if sum(map(len, held)) > 4 << 20:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int, ties: bool) -> DataFrame:
    """The words of the highest counts: at most ``most``, or with ``ties`` all up to the count level that holds
    the last of them. Levels are sixteenths of a doubling, so their tally on the driver has some hundred rows
    at any size, and a later collect fetches chosen words alone, not so many from every task."""
    level = F.floor(F.log2("n") * 16)
    tally = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    above, least = 0, None
    for r in sorted(tally, key=lambda r: -r["level"]):
        if above >= most or (above + r["words"] > most and not ties):
            break
        above, least = above + r["words"], r["level"]
    return counts.where(F.lit(False) if least is None else level >= least)


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> tuple[Network, np.ndarray, np.ndarray]:
    """(network, vocabulary, number): see ``word_numbers`` for the last two."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    counts = written(count_words(docs, text), "words")
    top = frequent(counts, VOCABULARY, ties=True).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary, number = hashes[order], order.astype(np.int64)
    share = np.array([r["n"] for r in top] + [max(0, total - sum(r["n"] for r in top)) / BUCKETS] * BUCKETS, np.float64)
    net = Network.start(share)
    words = len(share)

    for turn in range(rounds):
        sent = sc.broadcast((net.flat, vocabulary, number))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, vocab, num = sent.value  # noqa: B023
            own, memory = Network(words, flat.copy()), Network(words)
            seen = 0
            for batch in batches:
                data, offsets = textcore.flat_text(batch.column(0))
                for a, b in textcore.steps(offsets, STEP):
                    got, before = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ids = word_numbers(got, vocab, num)
                    places = turn_places(turn, rounds, stride, len(ids))  # noqa: B023
                    places = places[np.argsort(textcore.mix(places.astype(np.uint64)))]
                    for k in range(0, len(places), BATCH):
                        at = places[k : k + BATCH]
                        own.learn(windows(ids, before, at), ids[at], memory)
                    seen += len(places)
            if seen:
                rows = range(0, len(own.flat), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK for k in rows], pa.int32()), pa.array([seen] * len(rows), pa.int64()), pa.array([own.flat[k : k + BLOCK].tobytes() for k in rows], pa.binary())], names=["block", "seen", "part"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, seen, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    have = sums.setdefault(block, [0, 0.0])
                    have[0] += seen
                    have[1] = have[1] + seen * np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
            for block, (seen, part) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen], pa.int64()), pa.array([(part / seen).astype(np.float32).tobytes()], pa.binary())], names=["block", "seen", "part"])

        schema = "block int, seen long, part binary"
        parts = docs.select(F.col(text).cast("string")).mapInArrow(run, schema).repartition(8, "block").mapInArrow(average, schema).collect()
        flat = net.flat.copy()
        for r in parts:
            flat[r["block"] * BLOCK : r["block"] * BLOCK + len(r["part"]) // 4] = np.frombuffer(r["part"], np.float32)
        net = Network(words, flat)
    outside = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(r["word"],) for r in top], "word long")), "word", "left_anti")
    sums = {r["bucket"]: r["n"] for r in outside.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n")).collect()}
    net.rare = outside, [sums.get(k, 0) for k in range(BUCKETS)]
    return net, vocabulary, number


def score(docs: DataFrame, model: tuple[Network, np.ndarray, np.ndarray], text: str = "text", key: str = "doc_id", known: int = KNOWN) -> DataFrame:
    """key, n_words, log_likelihood (summed over all words), mean_log_likelihood."""
    bounded_batches(docs.sparkSession)
    net, vocabulary, number = model
    words = len(net.embed) - 1
    outside, sums = net.rare
    top = frequent(outside, known, ties=False).collect()  # at most ``known`` rows
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    fine = np.round(FINE * np.log(np.array([r["n"] for r in top], np.float64) / (np.array(sums, np.float64)[(hashes % np.uint64(BUCKETS)).astype(np.int64)] + 1))).astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((net.flat, vocabulary, number, hashes[order], fine[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vocab, num, rare, shares = sent.value
        own = Network(words, flat)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                got, before = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = word_numbers(got, vocab, num)
                each = np.zeros(len(ids))
                for k in range(0, len(ids), SCORED):
                    at = np.arange(k, min(len(ids), k + SCORED))
                    each[at] = own.log_probability(windows(ids, before, at), ids[at])
                n = np.diff(before)
                doc = np.repeat(np.arange(b - a), n)
                total = np.bincount(doc, each, b - a)
                out = np.flatnonzero(ids >= len(vocab))
                at = np.minimum(np.searchsorted(rare, got[out]), max(0, len(rare) - 1))
                have = rare[at] == got[out] if len(rare) else np.zeros(len(out), bool)
                share = np.zeros(b - a, np.int64)
                np.add.at(share, doc[out[have]], shares[at[have]])
                left = out[~have]
                cut = np.searchsorted(left, before).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(got[left].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(row + np.arange(b - a)), pa.array(n), pa.array(total), pa.array(share), tail], names=[key, *names])
                row += b - a

    at_row, n_words, total, share, tail = names = free_names(docs.select(F.col(key)), "row", "n_words", "total", "share", "tail")
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    rows = written(rows.mapInArrow(run, f"`{key}` long, `{at_row}` long, `{n_words}` long, `{total}` double, `{share}` long, `{tail}` array<long>"), "scored")
    bucket = F.array(*(F.lit(float(x)) for x in sums))[F.col("word").bitwiseAND(BUCKETS - 1).cast("int")]
    named = rows.select(F.col(at_row).alias("at"), F.explode(tail).alias("word")).join(outside, "word", "left")
    named = named.select("at", F.round(F.lit(FINE) * F.log(F.coalesce("n", F.lit(1)) / (bucket + 1))).cast("long").alias("part")).groupBy("at").agg(F.sum("part").alias("part"))
    said = F.col(total) + (F.col(share) + F.coalesce("part", F.lit(0))) / F.lit(FINE)
    whole = rows.join(named, rows[at_row] == named["at"], "left").select(rows[key], F.col(n_words).alias("n_words"), said.alias("log_likelihood"))
    return whole.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
