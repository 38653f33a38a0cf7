"""Prompts from retrieved passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passage(chunk_id: Column, section: Column, codes: Column, kind: Column, text: Column) -> Column:
    """A passage by id and section only; where it comes from is left out on purpose."""
    head = F.concat(F.lit("["), chunk_id.cast("string"), F.lit("]"), F.when(F.length(section) > 0, F.concat(F.lit(" (section: "), section, F.lit(")"))).otherwise(""))
    named = F.when(F.size(codes) > 0, F.concat(F.lit("Identifiers: "), F.array_join(codes, ", ")))
    return F.concat_ws("\n", head, named, F.when(kind == "table", "(table)"), text)


def user_prompt(question: Column, passages: Column) -> Column:
    """The question and the passages in their order."""
    parts = F.transform(passages, lambda x: F.concat(F.lit("\n\n"), x))
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext passages:"), F.array_join(parts, ""))


def user_prompts(hits: DataFrame) -> DataFrame:
    """(query_id, prompt) from rows query_id, question, rank, passage."""
    own = hits.groupBy("query_id").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(F.struct("rank", "passage"))).alias("own"))
    return own.select("query_id", user_prompt(F.col("question"), F.col("own")["passage"]).alias("prompt"))


def referenced_codes(resolved: Column, hit_codes: Column) -> Column:
    """The query's resolved codes if any, else the codes of the hits in rank order; each once. A hit may have none."""
    known = F.filter(hit_codes, lambda c: c.isNotNull())
    return F.when(F.size(resolved) > 0, F.array_distinct(resolved)).otherwise(F.array_distinct(F.flatten(known)))
