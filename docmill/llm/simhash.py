"""SimHash near-duplicates: 64-bit fingerprints linked within a few differing bits, by generalised pigeonhole.

**Fingerprints.** Every 4-word shingle of a text, repeats included, is hashed by XXH64; a bit of the
fingerprint is set if it is set in over half of the hashes. Documents of one fingerprint are one row from then on.

**Partitions.** The 64 bits are cut into m parts, correlated bits together. If part i may differ in at most
``T[i]`` bits and the T add up to ``DISTANCE - m + 1``, two fingerprints within ``DISTANCE`` bits agree that
closely in some part; T = -1 leaves a part out. For every m, T is found by dynamic programming on what a part
costs: the rows it sends, and the estimated number of fingerprints that a row meets there, from the bits'
frequencies over all fingerprints and from a sample's part values. The cheapest m counts, so parts get longer
as the table grows. Estimates decide what work is done, not what is found.

**Probes.** For T = 0 a fingerprint stands in one bucket, that of its part's value; for T = 1 it also probes those
of all values one bit away; for T = 2 fingerprints meet halfway: each stands in its own and all neighbouring
buckets. A task sees its buckets in order and verifies pairs by counting differing bits of the whole
fingerprints. Of a bucket only links leave that connect what it has not connected yet, fewer than its
rows, so a group of near copies makes no quadratic number of rows. A bucket that the sample shows to be large
is dealt to several: every two of its blocks meet in one.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other;
repeated rows and null keys take part; a component of null keys alone has a null id; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import textcore
from docmill.llm.components import connected_components
from docmill.llm.shared import bounded_batches, written

SIZE = 4
SEED = 42
BITS = 64
DISTANCE = 4
#: Most parts to consider; more than DISTANCE + 1 would leave parts out from the start.
MOST_PARTS = DISTANCE + 1
#: Fingerprints that estimates are made from, at most about twice as many.
SAMPLE = 1 << 15
#: Pairs of fingerprints that are verified in the time that one row takes to be sent.
PAIRS_PER_ROW = 50
#: Rows of one bucket that one task compares with each other; larger ones are dealt to several.
BLOCK = 1 << 13
#: Rows that a task holds at a time, beyond the bucket that it is at.
HELD = 1 << 16
#: Bytes of text that one vectorised step handles.
STEP = 1 << 19
_BYTES = np.uint64(0x0101010101010101)


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fingerprint of every document, as unsigned 64-bit integers."""
    text = textcore.lower_ascii(data)
    start, end, before = textcore.words(text, offsets)
    # words one after the other with one space between, so that a shingle is one slice
    width = end - start + 1
    index = textcore.take_ranges(start, width)
    stop = np.cumsum(width)
    index[stop - 1] = len(text)
    raw = np.append(text, np.uint8(32))[index].tobytes()
    begin, stop = stop - width, stop - 1
    count = np.diff(before)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = textcore.take_ranges(before[:-1], n)
    doc = np.repeat(np.arange(len(count)), n)
    last = np.minimum(at + size, before[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[last].tolist(), strict=True)], np.uint64)
    return majority(hashes, n)


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of every document's n hashes, the bits that over half of them have; 0 for none.

    Eight bits at a time are counted in the eight bytes of a word, over pieces of at most 255 hashes."""
    out = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    pieces = -(-n[has] // 255)
    first = np.cumsum(n[has]) - n[has]
    cuts = np.repeat(first, pieces) + 255 * textcore.take_ranges(np.zeros(len(has), np.int64), pieces)
    of = np.cumsum(pieces) - pieces
    got = np.zeros(len(has), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _BYTES, cuts)
        counts = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        most = 2 * counts > n[has][:, None]
        for byte in range(8):
            got |= most[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    out[has] = got
    return out


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every whole text; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                got = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(got.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` long, fp long")


def _unpacked(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the lowest first."""
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, how many have both bits set) for every two bits, over all rows of a column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _unpacked(batch.column(0).to_numpy().view(np.uint64)).astype(np.float64)
            both += bits.T @ bits
            rows += len(bits)
        if rows:
            a, b = np.triu_indices(BITS)
            place = np.append(a * BITS + b, -1)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.append(both[a, b], rows).astype(np.int64))], names=["place", "n"])

    counts = fps.select("fp").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # 2,081 rows
    both, rows = np.zeros((BITS, BITS)), 0
    for place, n in counts:
        if place < 0:
            rows = n
        else:
            both[place // BITS, place % BITS] = both[place % BITS, place // BITS] = n
    return rows, both


def correlated_parts(rows: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of about equal size; each begins with the free bit that is most correlated with
    another and takes, one by one, the bit that is most correlated with what it has."""
    p = np.diag(both) / max(1, rows)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(both / max(1, rows) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(strength, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        listed = sorted(free)
        own = [max(listed, key=lambda b: strength[b, listed].max())]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: strength[b, own].sum())
            own.append(best)
            free.discard(best)
        parts.append(sorted(own))
    return parts


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def meeting_chances(rows: int, both: np.ndarray, sample: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """For t = 0 .. most, the share of fingerprints that differ from a given one in at most t bits of the part:
    as if bits were independent, or in the sample if it is more there."""
    p = np.diag(both)[part] / max(1, rows)
    differ = 2 * p * (1 - p)
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    out = np.cumsum(chance)
    if len(sample) > 1:
        asked = sample[: 1 << 9] & np.uint64(_mask(part))
        apart = np.bitwise_count(asked[:, None] ^ (sample & np.uint64(_mask(part)))[None, :])
        pairs = apart.size - len(asked)  # without each one's own
        out = np.maximum(out, [((apart <= t).sum() - len(asked)) / max(1, pairs) for t in range(most + 1)])
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """(cost, T) with the T adding up to ``total`` and the least sum of costs[i][T[i] + 1]; T[i] is -1 or more."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(own, start=-1):
                if cost + c < step.get(used + t, (np.inf, []))[0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


class Plan:
    """Parts of the bits, their thresholds, and the buckets that are to be dealt to several."""

    def __init__(self, rows: int, both: np.ndarray, sample: np.ndarray):
        options = []
        for m in range(2, MOST_PARTS + 1):
            parts = correlated_parts(rows, both, m)
            costs = []
            for part in parts:
                met = meeting_chances(rows, both, sample, part, 2)
                costs.append([0.0, *(_ball(len(part), -(-t // 2)) + rows * met[t] / PAIRS_PER_ROW for t in range(3))])
            cost, thresholds = allocate(costs, DISTANCE - m + 1)
            options.append((cost, parts, thresholds))
        self.cost, self.parts, self.thresholds = min(options, key=lambda o: o[0])
        self.flips = []
        for part, t in zip(self.parts, self.thresholds, strict=True):
            masks = [sum(1 << b for b in some) for r in range(-(-max(t, 0) // 2) + 1) for some in combinations(part, r)]
            self.flips.append(np.array(masks if t >= 0 else [], np.uint64))
        self.blocks: dict[int, int] = {}
        keys, _, _ = self.probes(sample)
        value, count = np.unique(keys, return_counts=True)
        for v, c in zip(value[count >= 8].tolist(), count[count >= 8].tolist(), strict=True):
            expected = c * rows / max(1, len(sample))
            if expected > BLOCK:
                self.blocks[v] = int(-(-expected // BLOCK))
        self.listed = np.array(sorted(self.blocks), np.uint64)
        self.split = np.array([self.blocks[v] for v in self.listed.tolist()], np.int64)

    def probes(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, row of fp, own) of every row to send: ``own`` rows stand in a bucket, others only probe it.
        Buckets are named by hashes; if two had one name, only more pairs would be verified."""
        keys, rows, own = [], [], []
        for k, (part, t, flips) in enumerate(zip(self.parts, self.thresholds, self.flips, strict=True)):
            if not len(flips):
                continue
            value = (fp & np.uint64(_mask(part)))[:, None] ^ flips[None, :]
            keys.append(textcore.mix(value.ravel() ^ np.uint64(((k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))))
            rows.append(np.repeat(np.arange(len(fp)), len(flips)))
            own.append(np.tile(np.arange(len(flips)) < _ball(len(part), t // 2), len(fp)))
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)

    def dealt(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``probes`` with large buckets cut to blocks, a bucket for every two of them; in steps of bounded size."""
        keys, rows, own = self.probes(fp)
        if not len(self.listed):
            yield keys, rows, own
            return
        at = np.minimum(np.searchsorted(self.listed, keys), len(self.listed) - 1)
        blocks = np.where(self.listed[at] == keys, self.split[at], 1)
        mine = (textcore.mix(fp + np.uint64(1))[rows] % blocks.astype(np.uint64)).astype(np.int64)
        for a, b in textcore.steps(np.concatenate([[0], np.cumsum(blocks)]), HELD):
            again = np.repeat(np.arange(a, b), blocks[a:b])
            other = textcore.take_ranges(np.zeros(b - a, np.int64), blocks[a:b])
            low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
            yield textcore.mix(keys[again] + (low << 32 | high).astype(np.uint64)), rows[again], own[again]


def verified_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links within buckets, fewer than a bucket's rows, that connect what its links connect.

    Rows are in order of their bucket; row i meets i + 1, i + 2, .. as long as the bucket goes on."""
    n = len(key)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        a, b = at, at + step
        fresh = (parent[a] != parent[b]) & (own[a] | own[b])
        a, b = a[fresh], b[fresh]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        if near.any():
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((i, j))
            while (parent[parent] != parent).any():
                parent = parent[parent]
        step += 1
    got = np.array(out, np.int64).reshape(-1, 2)
    return fp[got[:, 0]], fp[got[:, 1]]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, each once) that connect all that differ in at most
    ``DISTANCE`` bits; not every such pair is listed."""
    rows, both = bit_counts(fps)
    # about SAMPLE rows, drawn by hash: estimates alone come from them
    share = max(1, rows // SAMPLE)
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = Plan(rows, both, drawn)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(all_), 1 << 12):
                fp = all_[a : a + (1 << 12)]
                for keys, at, own in plan.dealt(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[at].view(np.int64)), pa.array(own)], names=["bucket", "fp", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, fp, own = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(3))
            a, b = verified_links(key, fp.view(np.uint64), own)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            if held and sum(map(len, held)) + len(batch) > HELD:
                # up to where this batch's first or last bucket begins, whichever ends what is held
                cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
                if cut or held[-1].column(0)[-1].as_py() != key[0]:
                    yield linked([*held, batch.slice(0, cut)])
                    held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield linked(held)

    sent = fps.select("fp").mapInArrow(send, "bucket long, fp long, own boolean")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint in 16 hexadecimal digits, component_id: the least key that links reach)."""
    rows = written(fingerprint_documents(docs, text, key), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = connected_components(links(classes))
    placed = written(classes.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
