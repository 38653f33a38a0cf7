"""Incremental updates of an index from a folder whose files come and are rewritten."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.operators.chunking import content_hash
from docmill.operators.lifecycle import update
from docmill.sources.documents import SUFFIXES

LISTING = "path string, time long, length long, listed long"
_FILE = "path string, time long, length long"


def write_listing(spark: SparkSession, folder: str, checkpoint: str, suffixes: tuple[str, ...] = SUFFIXES) -> None:
    """Adds what the folder holds now to the listings that the stream with this checkpoint reads; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    wanted = found.where(F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    wanted.select("path", F.unix_micros("modificationTime").alias("time"), "length", F.lit(time.time_ns()).alias("listed")).write.mode("append").parquet(f"{checkpoint}/listings")


def _moved(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The file as last listed, if its time or length is another than the stored one."""
    rows = pd.concat(frames)
    last = rows.loc[rows["listed"].idxmax()]
    seen = (int(last["time"]), int(last["length"]))
    if not state.exists or tuple(state.get) != seen:
        state.update(seen)
        yield pd.DataFrame({"path": [key[0]], "time": [seen[0]], "length": [seen[1]]})


def changed_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A stream of (path, time, length) of files that are new or were rewritten since they were last listed.

    The state is a row a path, so a file put back to an earlier time is seen too. A file rewritten with the same
    length within its store's resolution of time is not told from the old one.
    """
    listings = spark.readStream.schema(LISTING).option("cleanSource", "delete").parquet(f"{checkpoint}/listings")
    return listings.groupBy("path").applyInPandasWithState(_moved, _FILE, "time long, length long", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(
    spark: SparkSession, folder: str, index: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], model: str = "", every: str | None = None
) -> StreamingQuery:
    """Lists the folder and brings the index up to date with files that are new or rewritten, then ends; with
    ``every`` ("1 minute") it goes on, and takes what further calls of ``write_listing`` find.

    Only changed files are opened. A file that is gone by then is left out. A batch that is repeated after a
    failure finds its files in the index by their contents and skips them.
    """
    write_listing(spark, folder, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        there = own.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
        # as Spark's own listing, the driver holds the paths that are to be opened, not what is in them
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in there.join(batch.select("path"), "path", "left_semi").collect()]
        if paths:
            files = own.read.format("binaryFile").load(paths)
            rows = files.select(F.col("path").alias("source_path"), "content", content_hash(F.col("content")).alias("content_hash"))
            update(own, index, rows, parse, embed, model, now=str(number))

    writer = changed_files(spark, checkpoint).writeStream.foreachBatch(apply).outputMode("append").option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
