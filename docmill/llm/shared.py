"""Places that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmill.session import shared_folder


#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share; see ``session.shared_folder``."""
    return shared_folder(spark, what)


def bounded_batches(spark: SparkSession) -> None:
    """Limits an Arrow batch by its bytes unless the session does so already: 10,000 rows of long text
    would be far too much for a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) >= 64 << 20:
        spark.conf.set(name, str(8 << 20))


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once to a Parquet table in the shared folder and read from there: cuts the
    lineage, survives lost executors, and is computed once however often it is used.

    Shuffle files of the write go when it ends. Otherwise they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Deletes what ``written`` made, once no later step reads it."""
    path = df_or_path if isinstance(df_or_path, str) else df_or_path.inputFiles()[0].rsplit("/", 1)[0]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Least and largest number of bits of the filter below; the largest takes 16 MB, whatever the data.
FILTER_BITS, MOST_BITS = 1 << 23, 1 << 27


def hash_filter(df: DataFrame, column: str, rows: int = 0):
    """A broadcast bitmap in which the bits of all (long) values are set. It has ``FILTER_BITS`` bits, or where
    ``rows`` tells about how many values there are eight for each, up to ``MOST_BITS``.

    Rows whose bit is not set surely have no partner, so they need no shuffle. When more values are there
    than the bitmap can tell apart it lets everything through: results never depend on it.
    """
    spark = df.sparkSession
    size = min(MOST_BITS, max(FILTER_BITS, 1 << max(0, 8 * rows - 1).bit_length()))

    def run(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[filter_place(batch.column(0).drop_null().to_numpy(), size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def unite(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0):
                bits |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    parts = df.select(column).mapInArrow(run, "bits binary")
    few = parts.repartition(16).mapInArrow(unite, "bits binary").repartition(1).mapInArrow(unite, "bits binary")
    rows = few.collect()
    bits = np.frombuffer(rows[0]["bits"], np.uint8) if rows else np.zeros(size // 8, np.uint8)
    return spark.sparkContext.broadcast(bits)


def filter_place(values: np.ndarray, size: int) -> np.ndarray:
    x = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def may_have(bits, values: np.ndarray) -> np.ndarray:
    """Whether the filter can't rule a value out."""
    place = filter_place(values, 8 * len(bits.value))
    return ((bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)


def may_pass(df: DataFrame, column: str, bits, keep: bool = True) -> DataFrame:
    """The rows that the filter can't rule out, or those that it rules out; ``column`` is a long."""
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_have(bits, batch.column(at).fill_null(0).to_numpy()) == keep))

    return df.mapInArrow(run, df.schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until no column of the frame is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
