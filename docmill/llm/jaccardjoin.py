"""Jaccard join on word shingles by vertical partitioning.

**Global order.** Shingles are ordered from rare to frequent, by the logarithm of their count in a
fixed-size sketch of the whole corpus and then by hash. The order's key stands for the shingle itself: 6
bits of frequency class, 58 bits of hash. Only speed depends on the sketch; any order gives exact results.

**Candidates.** Equal sets are one row from the start. A link needs a shared shingle among the first
``n - ceil(threshold * n) + 1`` of each set (prefix filter). Documents with such a shingle in common form
groups; a group is named by an XOR of its members' hashes, so each different group is looked at once,
however many shingles its members share. In a group, a parity bitmap of each set bounds the overlap of
two sets (each odd bit is at least one shingle that only one has): pairs that surely don't link are left
out, and of the rest the likeliest that would connect components still apart are proposed.

**Fragments.** Proposed pairs are verified exactly: the order is cut into fragments of equal mass, a
pair's partial overlaps are counted in each fragment apart, and summed. Linked pairs merge components;
refused pairs are remembered. Rounds go on until no group has a pair that could still connect two
components. Thus no link between components is lost, and links within one need not be listed.

**Skew.** Grouping, naming and joining are aggregations with map-side combining and joins that Spark
splits when skewed; a group of more than ``BLOCK`` members is dealt to pairs of blocks.

Defined results: null or empty text and text without words has the empty set and links with nothing;
repeated rows and equal sets link; null keys take part, and a component of null keys alone has a null id;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.llm import textcore
from docmill.llm.components import connected_components
from docmill.llm.shared import bounded_batches, free_names, hash_filter, may_pass, written
from docmill.llm.shingles import SIZE, STEP, shingle_sets

#: The link condition: NUMERATOR / DENOMINATOR of the union must be shared.
NUMERATOR, DENOMINATOR = 4, 5
SKETCH_BITS = 20
FRAGMENTS = 4
#: Members of a group that one task compares; larger groups are dealt to pairs of blocks.
BLOCK = 2048
#: Members of a group whose pairs are all looked at together with those of other groups.
SMALL = 128
#: Pairs of a task that all go out in rounds after the first.
FEW = 20_000


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def frequency_classes(source: DataFrame, size: int) -> np.ndarray:
    """log2 of the corpus-wide counts of hashed shingles, in 2**SKETCH_BITS fixed places (1 MB of bytes).

    Each task sends one count array in blocks; blocks are summed a place at a time. The driver gets
    ``2**SKETCH_BITS`` bytes whatever the corpus holds.
    """
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(0))
            for a, b in textcore.steps(offsets, STEP):
                hashes, _ = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size, distinct=False)
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        small = np.minimum(total, 0xFFFF).astype("<u2")
        rows = range(0, 1 << SKETCH_BITS, block)
        yield pa.RecordBatch.from_arrays([pa.array([k // block for k in rows], pa.int32()), pa.array([small[k : k + block].tobytes() for k in rows], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(c.as_buffer(), "<u2").astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        for k, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.frexp(c.astype(np.float64))[1].astype(np.uint8).tobytes()], pa.binary())], names=["block", "classes"])

    parts = source.select("text").mapInArrow(count, "block int, counts binary").repartition(16, "block").mapInArrow(add, "block int, classes binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in parts.collect():  # 2**SKETCH_BITS bytes in all
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["classes"], np.uint8)
    return out


def ordered_sets(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order keys, offsets): every document's set in the global order."""
    hashes, at = shingle_sets(data, offsets, size)
    keys = (classes[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys = keys[np.lexsort((keys, doc))]
    new = np.ones(len(keys), bool)  # two hashes that differ in the last bits alone are one
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], np.searchsorted(doc[new], np.arange(len(at)))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-NUMERATOR * n // DENOMINATOR) + 1, 0)


def bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of n: a power of two, from 64, at least twice the size."""
    return max(64, 1 << int(2 * n - 1).bit_length()) if n else 64


def parity_bitmap(keys: np.ndarray) -> bytes:
    bits = bitmap_bits(len(keys))
    place = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _signatures(classes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            for a, b in textcore.steps(offsets, STEP):
                keys, at = ordered_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classes.value, size)
                n = np.diff(at)
                own = [keys[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], pa.binary()),
                        pa.array(n.astype(np.int32)),
                        pa.array([x[:p].tobytes() for x, p in zip(own, prefix_length(n), strict=True)], pa.binary()),
                        pa.array([parity_bitmap(x) for x in own], pa.binary()),
                    ],
                    names=["key", "h", "digest", "n", "prefix", "bitmap"],
                )

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textcore.flat_text(batch.column(1))
        per = np.diff(offsets) // 8
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), per))], names=["token", "tid"])


class Members:
    """The different members of a task's groups: sizes, labels and parity bitmaps, by bitmap width."""

    def __init__(self, tid: np.ndarray, n: np.ndarray, label: np.ndarray, bitmaps: list[bytes]):
        self.tid, self.n = tid, n.astype(np.int64)
        _, self.label = np.unique(label, return_inverse=True)
        self.width = np.array([len(b) // 8 for b in bitmaps], np.int64)
        self.rank = np.zeros(len(tid), np.int64)
        self.matrix: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.rank[own] = np.arange(len(own))
            self.matrix[int(w), int(w)] = np.frombuffer(b"".join(bitmaps[k] for k in own), np.uint64).reshape(len(own), w)

    def rows(self, members: np.ndarray, w: int, to: int) -> np.ndarray:
        """Bitmaps of members of width w, folded by XOR to width ``to``."""
        if (w, to) not in self.matrix:
            self.matrix[w, to] = np.bitwise_xor.reduce(self.matrix[w, w].reshape(-1, w // to, to), axis=1)
        return self.matrix[w, to][self.rank[members]]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Highest possible Jaccard similarity of pairs by size and bitmap; 0 where they surely don't link.

        Each odd bit of the XOR of two bitmaps is at least one shingle that only one of the sets has.
        """
        total = self.n[a] + self.n[b]
        need = -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))
        out = np.zeros(len(a))
        fits = np.flatnonzero((np.minimum(self.n[a], self.n[b]) >= need) & (self.label[a] != self.label[b]))
        low, high = np.minimum(self.width[a[fits]], self.width[b[fits]]), np.maximum(self.width[a[fits]], self.width[b[fits]])
        for code in np.unique(low * (1 << 32) + high):
            lo, hi = int(code >> 32), int(code & 0xFFFFFFFF)
            own = fits[(low == lo) & (high == hi)]
            for k in range(0, len(own), step := max(1, (4 << 20) // (8 * lo))):
                at = own[k : k + step]
                wide, narrow = np.where(self.width[a[at]] == hi, a[at], b[at]), np.where(self.width[a[at]] == hi, b[at], a[at])
                odd = np.bitwise_count(self.rows(wide, hi, lo) ^ self.rows(narrow, lo, lo)).sum(axis=1, dtype=np.int64)
                shared = (total[at] - odd) // 2
                out[at] = np.where(shared >= need[at], shared / (total[at] - shared), 0.0)
        return out


def all_pairs(members: Members, groups: list[np.ndarray], sides: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b) of all pairs within small groups, each once; in groups of two blocks only those across."""
    found = []
    for m in {len(g) for g in groups}:
        own = [k for k, g in enumerate(groups) if len(g) == m]
        i, j = np.triu_indices(m, 1)
        rows, side = np.array([groups[k] for k in own]), np.array([sides[k] for k in own])
        two = (side.min(axis=1) != side.max(axis=1))[:, None]
        a, b = rows[:, i], rows[:, j]
        ok = (members.label[a] != members.label[b]) & ~(two & (side[:, i] == side[:, j]))
        found.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def likeliest_tree(members: Members, group: np.ndarray, side: np.ndarray, refused: dict[int, set[int]]) -> list[tuple[int, int, float]]:
    """Edges (a, b, likeness) of a maximum spanning forest over the labels of one large group."""
    two = side.min() != side.max()
    label = members.label[group]
    best, source = np.zeros(len(group)), np.zeros(len(group), np.int64)
    outside = np.ones(len(group), bool)
    edges: list[tuple[int, int, float]] = []
    while outside.any():
        v = int(np.argmax(np.where(outside, best, -1.0)))
        if best[v] > 0:
            edges.append((int(group[source[v]]), int(group[v]), float(best[v])))
        fresh = np.flatnonzero(outside & (label == label[v]))
        outside[fresh] = False
        for x in fresh:
            rest = np.flatnonzero(outside & (side != side[x]) if two else outside)
            like = members.likeness(np.full(len(rest), group[x]), group[rest])
            if no := refused.get(int(group[x])):
                like[np.isin(group[rest], list(no))] = 0.0
            better = like > best[rest]
            best[rest[better]], source[rest[better]] = like[better], x
    return edges


def spanning_forest(label: np.ndarray, edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The edges, likeliest first, that join labels not joined so far."""
    parent = list(range(int(label.max()) + 1)) if len(label) else []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = find(int(label[a])), find(int(label[b]))
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def cross_pairs(members: Members, group: np.ndarray, side: np.ndarray) -> list[tuple[int, int, float]]:
    """All pairs of one large group that may link two labels, from each member outside its main label."""
    two = side.min() != side.max()
    label = members.label[group]
    kinds, count = np.unique(label, return_counts=True)
    out: list[tuple[int, int, float]] = []
    for x in np.flatnonzero(label != kinds[np.argmax(count)]):
        rest = np.flatnonzero((label != label[x]) & (side != side[x]) if two else label != label[x])
        like = members.likeness(np.full(len(rest), group[x]), group[rest])
        out += [(int(group[x]), int(y), float(w)) for y, w in zip(group[rest][like > 0], like[like > 0], strict=True)]
    return out


def propose(members: Members, groups: list[np.ndarray], sides: list[np.ndarray], refused: set[tuple[int, int]], first: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of members to verify, so that the labels of these groups get connected as far as they can be,
    and whether these are all pairs that are left.

    ``refused`` holds pairs of members that are known not to link. The ``first`` round takes a maximum
    spanning forest by likeness; later ones take all that is left, or if that is more than ``FEW`` the
    forest and each label's likeliest pairs.
    """
    small = [k for k, g in enumerate(groups) if len(g) <= SMALL]
    pairs = all_pairs(members, [groups[k] for k in small], [sides[k] for k in small])
    like = members.likeness(pairs[:, 0], pairs[:, 1])
    may = like > 0
    edges = list(zip(pairs[may, 0].tolist(), pairs[may, 1].tolist(), like[may].tolist(), strict=True))
    whole = True
    not_with: dict[int, set[int]] = {}
    for x, y in refused:
        not_with.setdefault(x, set()).add(y)
        not_with.setdefault(y, set()).add(x)
    for k, g in enumerate(groups):
        if len(g) > SMALL:
            whole = whole and not first
            edges += likeliest_tree(members, g, sides[k], not_with) if first else cross_pairs(members, g, sides[k])
    edges = list({(min(a, b), max(a, b)): w for a, b, w in edges if (min(a, b), max(a, b)) not in refused}.items())
    edges = [(a, b, w) for (a, b), w in edges]
    if not first and len(edges) <= FEW:
        return sorted((a, b) for a, b, _ in edges), whole
    out = set(spanning_forest(members.label, edges))
    if not first:
        taken: dict[int, int] = {}
        for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
            x, y = int(members.label[a]), int(members.label[b])
            if min(taken.get(x, 0), taken.get(y, 0)) < 16:
                taken[x], taken[y] = taken.get(x, 0) + 1, taken.get(y, 0) + 1
                out.add((a, b))
    return sorted(out), whole and len(out) == len(edges)


def _propose_groups(batches: Iterator[pa.RecordBatch], first_round: bool) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    col = {c: table.column(c).to_numpy() for c in ("g1", "g2", "part", "tid", "n", "label", "block")}
    tid, first, member = np.unique(col["tid"], return_index=True, return_inverse=True)
    bitmap, no = table.column("bitmap").combine_chunks(), table.column("refused").combine_chunks()
    members = Members(tid, col["n"][first], col["label"][first], [bitmap[int(k)].as_py() for k in first])
    order = np.lexsort((col["part"], col["g2"], col["g1"]))
    new = np.flatnonzero(np.concatenate([[True], np.any([col[c][order][1:] != col[c][order][:-1] for c in ("g1", "g2", "part")], axis=0)]))
    cuts = [order[i:j] for i, j in zip(new, np.append(new[1:], len(order)), strict=True) if j > i + 1]
    refused: set[tuple[int, int]] = set()
    for x, k in enumerate(first):
        if others := no[int(k)].as_py():
            at = np.searchsorted(tid, others)
            refused.update((min(x, int(y)), max(x, int(y))) for y, o in zip(at, others, strict=True) if y < len(tid) and tid[y] == o)
    found, whole = propose(members, [member[c] for c in cuts], [col["block"][c] for c in cuts], refused, first_round)
    if found:
        pairs = np.sort(tid[np.array(found)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([whole] * len(pairs))], names=["a", "b", "whole"])


def _segments(classes, pivots: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textcore.flat_text(batch.column(1))
            tids = batch.column(0).to_numpy()
            for a, b in textcore.steps(offsets, STEP):
                keys, at = ordered_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classes.value, size)
                tid, part, segment = [], [], []
                for k in range(b - a):
                    own = keys[at[k] : at[k + 1]]
                    cut = np.concatenate([[0], np.searchsorted(own, pivots), [len(own)]])
                    for f in np.flatnonzero(np.diff(cut)):
                        tid.append(tids[a + k])
                        part.append(f)
                        segment.append(own[cut[f] : cut[f + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(tid, pa.int64()), pa.array(part, pa.int32()), pa.array(segment, pa.binary())], names=["tid", "part", "segment"])

    return run


def _partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(len(batch), np.int64)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort(kind="stable")
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(out)], names=["a", "b", "part", "shared"])


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, shared) of the pairs that share anything: partial overlaps by fragment, summed. Where repeated
    rows gave a set's segments twice they count once."""
    right = pairs.join(segments.toDF("b", "part", "y"), "b")
    both = right.join(segments.toDF("a", "part", "x"), ["a", "part"])
    return both.select("a", "b", "x", "y", "part").mapInArrow(_partial_overlaps, "a long, b long, part int, shared long").groupBy("a", "b", "part").agg(F.max("shared").alias("shared")).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _first_rows(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(tid, n, prefix, bitmap) of each set's first row. A filter of fixed size tells most of them from
    later rows; only what it can't tell is joined."""
    later = rows.where("n > 0").select("rid", "digest").join(sets.select("digest", "tid"), "digest").where("rid <> tid")
    bits = hash_filter(later, "rid")
    wide = rows.where("n > 0").select(F.col("rid").alias("tid"), "n", "prefix", "bitmap")
    return may_pass(wide, "tid", bits, keep=False).union(may_pass(wide, "tid", bits).join(sets.select("tid"), "tid", "left_semi"))


def _texts_of(source: DataFrame, holders: DataFrame) -> DataFrame:
    """(tid, text) of the holders, found by key and text hash; a filter of fixed size spares most other
    texts the shuffle. Rows that repeat both give repeated rows."""
    bits = hash_filter(holders, "h")
    null = F.lit(-(2**63))
    left = may_pass(source, "h", bits).withColumn("at", F.coalesce("key", null)).drop("key")
    right = holders.withColumn("at", F.coalesce("key", null)).drop("key")
    return left.join(right, ["h", "at"]).select("tid", "text")


def linked_components(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, labels): rows (rid, key, digest, n) per document; sets (tid, digest, n) per different
    non-empty set; labels (v, root) of the sets that link with another set."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = _source(docs, text, key)
    counts = frequency_classes(source, size)
    classes = spark.sparkContext.broadcast(counts)
    mass = np.bincount(counts, weights=np.exp2(np.maximum(counts, 1) - 1.0) * (counts > 0), minlength=64)
    pivots = _pivots(mass)

    rows = written(source.mapInArrow(_signatures(classes, size), "key long, h long, digest binary, n int, prefix binary, bitmap binary").withColumn("rid", F.monotonically_increasing_id()), "signatures")
    sets = written(rows.where("n > 0").groupBy("digest").agg(F.min("rid").alias("tid"), F.min("n").alias("n")), "sets")
    # written, since a stage with several Python steps in a row has as many workers at once
    own = written(_first_rows(rows, sets), "first-rows")
    postings = written(own.select("tid", "prefix").mapInArrow(_explode, "token long, tid long"), "postings")
    shared = written(postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    some = may_pass(postings, "token", hash_filter(shared, "token")).join(shared, "token")
    name = [F.expr(f"bit_xor(xxhash64(tid, {k}))").alias(f"g{k}") for k in (1, 2)]
    groups = some.groupBy("token").agg(F.min(F.xxhash64("tid")).alias("leader"), *name)
    members = some.join(groups, "token").select("g1", "g2", "leader", "m", "tid").distinct()
    blocks = F.ceil(F.col("m") / block).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    # a member of block i is in the tasks of every pair of blocks (i, j); the pair (i, i) has one block
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "g1", "g2", "leader", "tid", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long").alias("part"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("block")
    )
    members = written(members, "members")

    involved = members.select("tid").distinct()
    details = written(own.select("tid", "n", "bitmap").join(involved, "tid"), "bitmaps")
    links: DataFrame | None = None
    refused: DataFrame | None = None
    labels = spark.createDataFrame([], "v long, root long")
    first = True
    while True:
        now = members.join(labels, F.col("tid") == F.col("v"), "left").withColumn("label", F.coalesce("root", "tid")).drop("v", "root")
        if not first:  # groups that are one component have nothing left to propose
            apart = now.groupBy("g1", "g2", "part").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("g1", "g2", "part")
            now = now.join(apart, ["g1", "g2", "part"])
        now = now.join(details, "tid")
        now = now.withColumn("refused", F.lit(None).cast("array<long>")) if first else now.join(refused.groupBy(F.col("a").alias("tid")).agg(F.collect_list("b").alias("refused")), "tid", "left")
        # groups with one leader mostly share their members: in one task a pair goes out once
        now = now.select("g1", "g2", "part", "tid", "n", "label", "block", "bitmap", "refused", "leader")
        dealt = now.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leader", "part")
        proposed = written(dealt.mapInArrow(partial(_propose_groups, first_round=first), "a long, b long, whole boolean").groupBy("a", "b").agg(F.min("whole").alias("whole")), "proposed")
        first = False
        done = proposed.agg(F.min("whole").alias("whole")).first()["whole"]
        if done is None:
            break
        proposed = proposed.select("a", "b")
        needed = proposed.select(F.col("a").alias("tid")).union(proposed.select("b")).distinct()
        holders = rows.select("key", "h", F.col("rid").alias("tid")).join(needed, "tid")
        segments = written(_texts_of(source, holders).mapInArrow(_segments(classes, pivots, size), "tid long, part int, segment binary"), "segments")
        size_of = details.select("tid", "n")
        judged = proposed.join(overlaps(proposed, segments), ["a", "b"], "left").join(size_of.toDF("a", "na"), "a").join(size_of.toDF("b", "nb"), "b")
        judged = written(judged.select("a", "b", (F.coalesce("shared", F.lit(0)) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("na") + F.col("nb"))).alias("link")), "judged")
        good, bad = judged.where("link").select("a", "b"), judged.where("not link").select("a", "b")
        links = good if links is None else links.union(good)
        refused = bad if refused is None else refused.union(bad)
        labels = connected_components(links)
        if done:
            break
    return rows.select("rid", "key", "h", "digest", "n"), sets, labels


def _pivots(mass: np.ndarray) -> np.ndarray:
    """Order keys that cut the whole mass of shingles into FRAGMENTS fragments of about equal mass."""
    share = np.cumsum(mass) / max(1.0, mass.sum())
    out = []
    for f in range(1, FRAGMENTS):
        c = min(int(np.searchsorted(share, f / FRAGMENTS)), len(mass) - 1)
        below = share[c - 1] if c else 0.0
        inside = (f / FRAGMENTS - below) / max(1e-12, share[c] - below)
        out.append((c << 58) + min(int(min(1.0, inside) * (1 << 58)), (1 << 58) - 1))
    return np.array(out, np.uint64)


def _with_roots(docs: DataFrame, size: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, named): all rows, and of those with shingles (rid, root, key, h)."""
    rows, sets, labels = linked_components(docs, size, text, key)
    roots = sets.join(labels, F.col("tid") == F.col("v"), "left").select("digest", F.coalesce("root", "tid").alias("root"))
    return rows, rows.where("n > 0").join(roots, "digest").select("rid", "root", "key", "h")


def component_ids(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) of every document."""
    rows, named = _with_roots(docs, size, text, key)
    least = named.groupBy("root").agg(F.min("key").alias("component_id"))
    out = rows.join(named.drop("key", "h"), "rid", "left").join(least, "root", "left")
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("key"))).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, that of the smallest key, with all its columns; documents without
    shingles stay."""
    rows, named = _with_roots(docs, size, text, key)
    null = F.lit(-(2**63))
    least = named.groupBy("root").agg(F.min(F.struct(F.coalesce("key", F.lit(2**63 - 1)).alias("o"), "key", "h", "rid")).alias("first"))
    kept = least.select(F.col("first.h").alias("h"), F.coalesce("first.key", null).alias("at"), F.lit(1).alias("most"))
    empty = rows.where("n = 0").groupBy("h", F.coalesce("key", null).alias("at")).agg(F.count("*").cast("int").alias("most"))
    h, at, most, nth = free_names(docs, "h", "at", "most", "nth")
    marked = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))).withColumn(at, F.coalesce(F.col(key).cast("long"), null))
    # rows that repeat both key and text are told apart by number alone
    number = F.row_number().over(W.partitionBy(h, at).orderBy(h))
    return marked.join(kept.unionByName(empty).toDF(h, at, most), [h, at]).withColumn(nth, number).where(F.col(nth) <= F.col(most)).select(*docs.columns)
