"""Approximate nearest neighbours by NN-descent and greedy graph search.

Nearness is the largest inner product. Vectors take part if they are whole: not null, no null or
non-finite component, and not zero; vectors of one length meet one another.

**Sizes.** With more rows a fixed share of work per row finds less, so repeats, degree, pool and beam follow
the row count (``sizes``); the constants are those for ``BASE`` rows and fewer.

**Start.** Each of ``repeats`` times a few vectors are drawn as pivots by hash; every vector goes to the
cell of its likeliest pivot, cells beyond ``CELL_MOST`` rows are split by hash, and in each cell the
likeliest partners become first neighbours. More than ``PIVOTS`` cells take several pivot sets together.

**Descent.** A round joins neighbours of neighbours: every node gathers its neighbours and up to
``reverse`` of the nodes that name it, with their vectors, and introduces them to one another; who beats a
node's worst neighbour is kept, and each node's best ``degree`` go on. Rounds end when no more than ``STOP``
of the edges are new, however many that takes.

**Search.** A query is a node: it begins with its own neighbours, and in each hop expands its ``beam``
likeliest nodes that it has not expanded, keeping the likeliest ``pool``, until no query's pool has a node
left to expand. The best of them are scored exactly, in double precision on the original vectors.

Half-precision unit vectors with their norms travel while the graph is built and searched. Reverse
neighbours, pivots and pools are bounded by the method itself; all vectors are indexed. Defined results:
rows that repeat an id, or id and vector, are rows of their own, as queries and as candidates; ties go to
the smaller id, and beyond the last rank any of the tied may stand; with few vectors all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.llm.shared import bounded_batches, written

REPEATS = 8
CELL = 1200
CELL_MOST = 2500
PIVOTS = 64
FIRST = 12
DEGREE = 24
REVERSE = 16
STOP = 0.02
POOL = 160
#: Rows up to which the sizes above hold.
BASE = 10_000
#: Gathered rows that one task holds at most, about.
PER_TASK = 200_000


@dataclass(frozen=True)
class Sizes:
    repeats: int
    degree: int
    reverse: int
    pool: int

    @property
    def beam(self) -> int:
        return self.pool // 2


def sizes(count: int) -> Sizes:
    """The sizes grow by a step with every doubling of the rows."""
    more = max(1.0, count / BASE)
    twice = math.log2(more)
    return Sizes(REPEATS + round(2 * twice), DEGREE + round(4 * twice), REVERSE + round(3 * twice), round(POOL + 48 * twice))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, key, v array<double>) of the rows that take part; id numbers the rows."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("id"), "key", "v")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, norm, half): unit vectors in half precision, least precise part of the index."""
    for batch in batches:
        if not len(batch):
            continue
        v = np.array(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
        most = np.abs(v).max(axis=1, keepdims=True)
        norm = np.sqrt(((v / most) ** 2).sum(axis=1)) * most[:, 0]
        half = (v / norm[:, None]).astype("<f2")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), _binary(half)], names=["id", "norm", "half"])


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long half-precision vectors as float32."""
    if not len(column):
        return np.zeros((0, 0), np.float32)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], "<f2")[at[0] // 2 : at[-1] // 2].reshape(len(column), -1).astype(np.float32)


def _cells(pivot_sets):
    """(repeat, cell, id, norm, half): the cell of each vector in each repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2))
            if not len(m):
                continue
            for r, sets in enumerate(pivot_sets.value):
                cell = np.zeros(len(m), np.int64)
                for pivots in sets:
                    cell = cell * len(pivots) + np.argmax(m @ pivots.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), r, np.int32)), pa.array(cell), batch.column(0), batch.column(1), batch.column(2)], names=["repeat", "cell", "id", "norm", "half"])

    return run


def _top(ids: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's largest entries; -inf entries are left out."""
    k = min(most, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(s, at, 1)
    row = np.repeat(np.arange(len(s)), k)
    ok = np.isfinite(got).ravel()
    return row[ok], at.ravel()[ok], got.ravel()[ok]


def _within_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("repeat", "cell", "part")])
    order = np.lexsort(group)
    new = np.flatnonzero(np.concatenate([[True], np.any(group[:, order[1:]] != group[:, order[:-1]], axis=0)]))
    ids, norm, half = table.column("id").to_numpy(), table.column("norm").to_numpy(), table.column("half").combine_chunks()
    for i, j in zip(new, np.append(new[1:], len(order)), strict=True):
        own = order[i:j]
        if len(own) < 2:
            continue
        m = _matrix(half.take(pa.array(own))) * norm[own, None].astype(np.float32)
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        row, col, got = _top(ids[own], s, FIRST)
        yield _edges(ids[own][row], ids[own][col], got)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], names=["a", "b", "s"])


_EDGES = "a long, b long, s float"


def best(edges: DataFrame, most: int) -> DataFrame:
    """Each node's ``most`` likeliest different neighbours."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    return once.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= most).drop("r")


def _introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's gatherings (node, member, norm, half, worst): the pairs of members that beat a worst."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    node, member, norm, worst = (table.column(c).to_numpy() for c in ("node", "member", "norm", "worst"))
    half = table.column("half").combine_chunks()
    order = np.argsort(node, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
    size = np.diff(np.append(new, len(order)))
    wide = int(size.max())
    for k in range(0, len(new), step := max(1, (4 << 20) // (wide * wide * 4))):
        first, n = new[k : k + step], size[k : k + step]
        at = first[:, None] + np.minimum(np.arange(wide), n[:, None] - 1)
        real = np.arange(wide) < n[:, None]
        rows = order[at]
        flat = rows.ravel()
        m = (_matrix(half.take(pa.array(flat))) * norm[flat, None].astype(np.float32)).reshape(*rows.shape, -1)
        s = m @ m.transpose(0, 2, 1)
        ok = real[:, :, None] & real[:, None, :] & (member[rows][:, :, None] != member[rows][:, None, :]) & (s > worst[rows][:, :, None])
        g, i, j = np.nonzero(ok)
        if len(g):
            # a pair may meet at many nodes of this task: once is enough
            a, b, got = member[rows[g, i]], member[rows[g, j]], s[g, i, j]
            by = np.lexsort((b, a))
            keep = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])
            yield _edges(a[by][keep], b[by][keep], got[by][keep])


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PER_TASK))


def first_graph(index: DataFrame, count: int) -> DataFrame:
    """Neighbours from the cells around drawn pivots."""
    size = sizes(count)
    cells = max(1, -(-count // CELL))
    levels = 1
    while PIVOTS**levels < cells:
        levels += 1
    per_set = max(1, round(cells ** (1 / levels)))
    wanted = size.repeats * levels * per_set
    drawn = index.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(wanted).select("half").collect()  # at most repeats * levels * PIVOTS rows
    pivots = np.stack([np.frombuffer(r["half"], "<f2").astype(np.float32) for r in drawn])
    sets = [[pivots[(np.arange(per_set) + (r * levels + k) * per_set) % len(pivots)] for k in range(levels)] for r in range(size.repeats)]
    sent = index.sparkSession.sparkContext.broadcast(sets)
    placed = index.mapInArrow(_cells(sent), "repeat int, cell long, id long, norm double, half binary")
    filled = placed.groupBy("repeat", "cell").agg(F.count("*").alias("n"))
    placed = placed.join(filled, ["repeat", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "repeat"), F.ceil(F.col("n") / CELL_MOST)).cast("int"))
    near = placed.repartition(_tasks(index, count * size.repeats), "repeat", "cell", "part").mapInArrow(_within_cells, _EDGES)
    return best(near, size.degree)


def descend(index: DataFrame, graph: DataFrame, count: int) -> DataFrame:
    """Rounds of introducing neighbours of neighbours, until few edges are new."""
    size = sizes(count)
    for number in itertools.count():  # scores of a node's neighbours only rise, so the new edges run out
        worst = graph.groupBy("a").agg(F.when(F.count("*") >= size.degree, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        named = graph.select(F.col("b").alias("node"), F.col("a").alias("member"))
        named = named.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("member", "node", F.lit(number)), "member"))).where(F.col("r") <= size.reverse).drop("r")
        met = graph.select(F.col("a").alias("node"), F.col("b").alias("member")).union(named).distinct()
        carried = index.join(worst, F.col("id") == F.col("a"), "left").select(F.col("id").alias("member"), "norm", "half", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        gathered = met.join(carried, "member").select("node", "member", "norm", "half", "worst")
        found = gathered.repartition(_tasks(index, count * (size.degree + size.reverse)), "node").mapInArrow(_introduce, _EDGES)
        following = written(best(graph.union(found), size.degree), "graph")
        total, kept = following.count(), following.join(graph.select("a", "b"), ["a", "b"], "left_semi").count()
        graph = following
        if total - kept <= STOP * total:
            break
    return graph


def build_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, graph): index (id, norm, half), graph (a, b, s) of rows (id, v) of one length."""
    index = written(rows.select("id", "v").mapInArrow(_halves, "id long, norm double, half binary"), "index")
    count = index.count()
    if count < 2:
        return index, rows.sparkSession.createDataFrame([], _EDGES)
    return index, descend(index, written(first_graph(index, count), "graph"), count)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores the neighbours of expanded nodes against their queries; those above the bar go on."""
    for batch in batches:
        if not len(batch):
            continue
        query, bar, qnorm = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("q", "bar", "qnorm"))
        qv = _matrix(batch.column(batch.schema.names.index("qhalf"))) * qnorm[:, None].astype(np.float32)
        near = batch.column(batch.schema.names.index("near"))
        size = np.diff(near.offsets.to_numpy())
        flat = near.flatten()
        cand, norm, half = flat.field("b").to_numpy(), flat.field("norm").to_numpy(), flat.field("half")
        row = np.repeat(np.arange(len(batch)), size)
        for k in range(0, len(row), 1 << 16):
            at = slice(k, k + (1 << 16))
            s = np.einsum("ij,ij->i", qv[row[at]], _matrix(half[at]) * norm[at, None].astype(np.float32))
            ok = np.flatnonzero((s > bar[row[at]]) & (cand[at] != query[row[at]]))
            if len(ok):  # neighbourhoods overlap: what a query meets here again goes out once
                q, c = query[row[at]][ok], cand[at][ok]
                by = np.lexsort((c, q))
                by = by[np.concatenate([[True], (q[by][1:] != q[by][:-1]) | (c[by][1:] != c[by][:-1])])]
                yield _edges(q[by], c[by], s[ok][by])


def search(rows: DataFrame, index: DataFrame, graph: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; ``queries`` has the rows' ids (q)."""
    size = sizes(index.count())
    near = graph.join(index.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.collect_list(F.struct("b", "norm", "half")).alias("near"))
    near = written(near, "adjacency")
    asked = written(queries.join(index, F.col("q") == F.col("id")).select("q", F.col("norm").alias("qnorm"), F.col("half").alias("qhalf")), "queries")
    pool = graph.join(asked.select(F.col("q").alias("a")), "a", "left_semi").withColumn("done", F.lit(False))
    by_score = W.partitionBy("a").orderBy(F.desc("s"), "b")
    while True:
        pool = pool.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= size.pool)
        pool = written(pool.withColumn("t", F.sum(F.when(F.col("done"), 0).otherwise(1)).over(by_score.rowsBetween(W.unboundedPreceding, 0))).withColumn("go", ~F.col("done") & (F.col("t") <= size.beam)), "pool")
        if not pool.where("go").head(1):
            break
        bars = pool.groupBy("a").agg(F.when(F.count("*") >= size.pool, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("bar"))
        front = pool.where("go").select(F.col("a").alias("q"), F.col("b").alias("node"))
        front = front.join(bars.withColumnRenamed("a", "q"), "q").join(asked, "q")
        found = front.join(near, front["node"] == near["a"]).select("q", "bar", "qnorm", "qhalf", "near").mapInArrow(_expand, _EDGES)
        both = pool.select("a", "b", "s", (F.col("done") | F.col("go")).alias("done")).union(found.withColumn("done", F.lit(False)))
        pool = both.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("done").alias("done"))
    final = pool.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= max(3 * k, 64)).select("a", "b")
    score = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    final = final.join(rows.select(F.col("id").alias("b"), F.col("key").alias("vec_id"), "v"), "b").join(rows.select(F.col("id").alias("a"), F.col("key").alias("query_id"), F.col("v").alias("qv")), "a")
    final = final.select("a", "query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Builds the graph over all rows and searches it for the rows whose id is divisible by ``every``.

    Vectors of different lengths have no inner product: each length has a graph of its own, one after the
    other, the most common first.
    """
    bounded_batches(vectors.sparkSession)
    every_row = written(usable(vectors, key, vector), "vectors")
    lengths = [r["d"] for r in every_row.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    out = None
    for d in lengths or [0]:
        rows = every_row.where(F.size("v") == d)
        index, graph = build_graph(rows)
        found = search(rows, index, graph, rows.where(F.col("key") % every == 0).select(F.col("id").alias("q")), k)
        out = found if out is None else out.unionByName(found)
    return out
