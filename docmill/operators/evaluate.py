"""Retrieval quality against a graded set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(cases: DataFrame) -> DataFrame:
    """Adds found_correct, page_hit, codes_resolved to rows with should_find, found, expected_pages, pages,
    expected_codes, codes. The last two are null where nothing is expected."""
    return cases.select(
        "*",
        (F.col("found") == F.col("should_find")).alias("found_correct"),
        F.when(F.size("expected_pages") > 0, F.arrays_overlap("expected_pages", "pages")).alias("page_hit"),
        F.when(F.size("expected_codes") > 0, F.size(F.array_except("expected_codes", "codes")) == 0).alias("codes_resolved"),
    )


def graded(cases: DataFrame, prepared: DataFrame) -> DataFrame:
    """``outcomes`` of a graded set (query_id, expected_pages, expected_codes, should_find) and what
    ``answering.prepare`` or ``ask`` made of its questions. Available codes are the resolved ones and those of the hits;
    a case that was not asked is not found."""
    hits = prepared.select("query_id", "found", F.col("retrieved")["page"].alias("pages"), F.array_union("resolved", F.coalesce(F.flatten(F.filter(F.col("retrieved")["codes"], lambda c: c.isNotNull())), F.array().cast("array<string>"))).alias("codes"))
    made = cases.join(hits, "query_id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return outcomes(made.select(
        "query_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("should_find", F.lit(True)).alias("should_find"), F.coalesce(F.col("expected_pages").cast("array<int>"), none("int")).alias("expected_pages"),
        F.coalesce(F.col("pages").cast("array<int>"), none("int")).alias("pages"), F.coalesce("expected_codes", none("string")).alias("expected_codes"), F.coalesce("codes", none("string")).alias("codes"),
    ))


def _rate(hit: Column, counted: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(counted & hit), F.count_if(counted)), F.lit(1.0))


def rates(graded: DataFrame) -> DataFrame:
    """One row with the four rates; a rate over no cases is 1."""
    every = F.lit(True)
    return graded.agg(
        _rate(F.col("found_correct"), every).alias("found_accuracy"),
        _rate(F.col("page_hit"), F.col("page_hit").isNotNull()).alias("page_hit_rate"),
        _rate(F.col("codes_resolved"), F.col("codes_resolved").isNotNull()).alias("code_resolution_rate"),
        _rate(~F.col("found"), ~F.col("should_find")).alias("not_found_accuracy"),
        F.count("*").alias("cases"),
    )
