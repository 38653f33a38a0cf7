"""Exact vector search, identifier lookup, and their merge, for many queries in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.config import RetrievalConfig

#: Vectors of one block of queries or of the corpus.
BLOCK = 1024
#: Queries of at most so many bytes go to every task; more are dealt to the blocks of vectors by a shuffle.
BROADCAST_BYTES = 32 << 20


def _blocks(vectors: DataFrame, count: int, name: str) -> DataFrame:
    """One row per block of about BLOCK vectors of one dimension: (dim, block, name array<struct<id, v>>)."""
    blocks = max(1, -(-count // BLOCK))
    keyed = vectors.select("id", "v", F.size("v").alias("dim")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return keyed.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias(name))


def _met(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(dim, q, c): every block of queries beside every block of vectors of its dimension. The pairs lie
    where the block of vectors lies, so they spread over all tasks."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    count = vectors.count()
    q, c = _blocks(queries, size["n"], "q").drop("block"), _blocks(vectors, count, "c")
    if size["n"] * (8 * size["d"] + 16) <= BROADCAST_BYTES:
        return c.join(F.broadcast(q), "dim").select("dim", "q", "c")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-count // BLOCK)) - 1))).cast("long")
    return c.join(q.withColumn("block", numbers), ["dim", "block"]).select("dim", "q", "c")


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which ids of a equal which of b."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy()
    return both[: len(a), None] == both[None, len(a) :]


def _scores(k: int, min_score: float, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                (qid, q), (cid, c) = (_unpack(batch.column(j)[row]) for j in (1, 2))
                s = _unit(q) @ _unit(c).T
                if exclude_self:
                    s[_same(qid, cid)] = -np.inf
                s[~(s >= min_score)] = -np.inf
                at = np.argsort(-s, axis=1, kind="stable")[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
                got = np.take_along_axis(s, at, 1)
                ok = np.isfinite(got)
                q_at = np.repeat(np.arange(len(s)), at.shape[1]).reshape(at.shape)
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(q_at[ok])), cid.take(pa.array(at[ok])), pa.array(got[ok])], names=["query_id", "chunk_id", "score"])

    return run


def _unpack(cell) -> tuple[pa.Array, np.ndarray]:
    """Ids of any type in order, and their vectors."""
    own = cell.values
    order = pc.sort_indices(own.field("id"))
    return own.field("id").take(order), np.array(own.field("v").flatten(), np.float64).reshape(len(own), -1)[order.to_numpy()]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def semantic(queries: DataFrame, vectors: DataFrame, config: RetrievalConfig, ranked: bool = True, exclude_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score[, rank]): each query's top_k by cosine among scores of at least min_score.

    Both sides are (id of any type that can be ordered, v array). Every block of queries meets every block of vectors in one numpy
    product, which keeps top_k of each query; the window then ranks blocks' winners. A null vector, or one
    with a null, takes no part; a zero vector scores 0; ties go to the lesser id. With ``exclude_self``, for queries taken from
    the vectors themselves, an id doesn't find itself.
    """
    clean = lambda df: df.where("v is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull()))
    kinds = [df.schema["id"].dataType for df in (queries, vectors)]
    if exclude_self and kinds[0] != kinds[1]:
        raise TypeError("ids of queries and vectors are of different types")
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    met = _met(clean(queries), clean(vectors)).mapInArrow(_scores(config.top_k, config.min_score, exclude_self), schema)
    if not ranked:
        return met
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.top_k)


def postings(chunks: DataFrame, *beside: str) -> DataFrame:
    """(value, columns beside, chunk_id) from chunks with codes: each chunk once per value."""
    # the outer form, since explode has the codes extracted once more for a filter on their number
    return chunks.select("chunk_id", *beside, F.explode_outer("codes.value").alias("value")).where("value is not null").distinct().select("value", *beside, "chunk_id")


def lookup(query_codes: DataFrame, index: DataFrame, *beside: str) -> DataFrame:
    """(query_id, columns beside, chunk_id) of chunks that hold any of a query's codes; all of them, without a cap."""
    on = ["bucket", "value"] if "bucket" in index.columns and "bucket" in query_codes.columns else ["value"]
    return query_codes.join(index, on).select("query_id", *beside, "chunk_id").distinct()


def resolved(query_codes: DataFrame, index: DataFrame) -> DataFrame:
    """The query codes that the index holds."""
    return query_codes.join(index.select("value"), "value", "left_semi")


def hybrid(semantic_hits: DataFrame, code_hits: DataFrame, config: RetrievalConfig, chunks: DataFrame | None = None, *beside: str) -> DataFrame:
    """(query_id, rank, chunk_id, score, match_type): the full outer join of both kinds of hits. Columns beside
    belong to a chunk's key, as in an index, where equal files have equal chunk ids.

    A code hit scores the base plus its cosine if it is a semantic hit too. Hits without a row in
    ``chunks`` are left out. Ranked by score, then chunk id.
    """
    key = ["chunk_id", *beside]
    code = code_hits.select("query_id", *key, F.lit(True).alias("by_code"))
    both = semantic_hits.select("query_id", *key, "score").join(code, ["query_id", *key], "full_outer")
    if chunks is not None:
        both = both.join(chunks.select(*key), key, "left_semi")
    kind = F.when(F.col("by_code").isNull(), "semantic").when(F.col("score").isNull(), "code").otherwise("hybrid")
    score = F.coalesce("score", F.lit(0.0)) + F.when(F.col("by_code"), config.code_base_score).otherwise(0.0)
    out = both.select("query_id", *key, score.alias("score"), kind.alias("match_type"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *key)))
