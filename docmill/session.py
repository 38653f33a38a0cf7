"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application.

    Where the cluster has the package installed this changes nothing; where only the driver's path has it,
    tasks could not import the functions that they run.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docmill-"), "docmill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Limits an Arrow batch to 8 MB unless the session has a limit below 64 MB already: rows that hold whole blocks
    of vectors, or whole files, are too large to go by their number."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) >= 64 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which driver and executors share. Where
    it is unset, a local session (as in tests) gets a temporary one; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once as Parquet to a new shared folder and read from there by whatever uses them."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
