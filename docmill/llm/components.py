"""Connected components by contraction: every vertex hooks to its least neighbour, edges are relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of the edges (long columns); root is the least vertex of its component.

    Each round one aggregation and three joins on the remaining edges, which at least halve as a rule;
    every round's edges and labels are written to the shared folder, so no lineage grows and nothing
    but two counts reaches the driver. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "edges")
    labels = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("root", F.col("v"))
    edges = written(_tidy(edges), "edges")
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("x")).agg(F.least(F.col("x"), F.min("b")).alias("p"))
        # one jump: hook to what the least neighbour itself hooks to
        jump = hook.select(F.col("x").alias("p"), F.col("p").alias("q"))
        hook = written(hook.join(jump, "p", "left").select("x", F.coalesce("q", "p").alias("p")), "hooks")
        labels = written(labels.join(hook, F.col("root") == F.col("x"), "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        left = edges.join(hook.toDF("a", "pa"), "a").select("b", "pa")
        edges = written(_tidy(left.join(hook.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    return labels


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
