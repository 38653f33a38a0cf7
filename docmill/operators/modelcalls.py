"""Calls of a model that are made once: results are stored by content and survive a failure midway.

A stage that asks a model (embeddings, replies, captions) is the dear part of a job. Here a call is keyed by a
checksum of what is asked and of the model's name. A run asks for what the store lacks, in portions of
``PORTION`` calls, each of which is in the store once its tasks are done; a run that fails, or a second one
over grown tables, goes on from there. Within a portion a lost executor costs the calls of its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calls of one portion, about; and calls that are handed to the model together.
PORTION, BATCH = 100_000, 32


def call_key(payload: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\x1f"), payload), 256)


def stored(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """(key, result) of what was asked so far."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = f"key string, result {kind}"
    return spark.read.schema(schema).parquet(store) if fs.exists(at) else spark.createDataFrame([], schema)


def missing(asked: DataFrame, spark: SparkSession, store: str, model: str, kind: str, payload: str = "payload") -> DataFrame:
    """(key, payload) of the different calls that the store lacks; a null payload is never asked."""
    own = asked.where(F.col(payload).isNotNull()).select(call_key(F.col(payload), model).alias("key"), F.col(payload).alias("payload")).dropDuplicates(["key"])
    return own.join(stored(spark, store, kind).select("key"), "key", "left_anti")


def ask(spark: SparkSession, store: str, asked: DataFrame, call: Callable[[list[str]], list], model: str, kind: str = "string", payload: str = "payload") -> DataFrame:
    """``asked`` with result (of the SQL type ``kind``): what the model says to each payload.

    ``call`` takes a list of payloads and returns as many results; it runs in the tasks. Equal payloads are one
    call. A null payload has a null result. A result of null is kept and not asked again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                results = call(part["payload"].tolist())
                if len(results) != len(part):
                    raise ValueError(f"{len(results)} results for {len(part)} calls")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "result": pd.Series(results, dtype=object).to_numpy()})

    portions = max(1, -(-missing(asked, spark, store, model, kind, payload).count() // PORTION))
    for k in range(portions):
        todo = missing(asked, spark, store, model, kind, payload).where(F.pmod(F.xxhash64("key"), F.lit(portions)) == k)
        todo.mapInPandas(run, f"key string, result {kind}").write.mode("append").parquet(store)
    key = "_call_key"
    return asked.withColumn(key, call_key(F.col(payload), model)).join(stored(spark, store, kind).withColumnRenamed("key", key), key, "left").drop(key)


def progress(spark: SparkSession, store: str, asked: DataFrame, model: str, kind: str = "string", payload: str = "payload") -> DataFrame:
    """One row: done and total, of different calls."""
    keys = asked.where(F.col(payload).isNotNull()).select(call_key(F.col(payload), model).alias("key")).distinct()
    known = keys.join(stored(spark, store, kind).select("key", F.lit(1).alias("known")), "key", "left")
    return known.agg(F.count("known").alias("done"), F.count("*").alias("total"))


def embedder(spark: SparkSession, store: str, call: Callable[[list[str]], list], model: str) -> Callable[[DataFrame], DataFrame]:
    """An ``embed`` for ``lifecycle.update`` and ``reembed`` that asks for each different text once, ever."""
    return lambda chunks: ask(spark, store, chunks.select("chunk_id", "source_path", "embedding_text"), call, model, "array<double>", "embedding_text").select("chunk_id", "source_path", F.col("result").alias("v"))
