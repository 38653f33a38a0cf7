"""A corpus pipeline of five stages over ``documents``.

Every stage works on all that the stage before kept, its result is written as Parquet to the shared folder
and read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import jaccardjoin, packing, quality, suffixdedup, toxicity
from docmill.llm.shared import written

#: So many words make a passage, if it has no 400 bytes.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection level; fitted on the table of labels.

    A null or empty text has no features and stays, as long as the fitted base severity is below the level. Repeated
    rows are judged alike; nothing is decided by rank, so there are no ties."""
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the compression bands.

    A null or empty text has no words, so it goes. Each row is judged by itself."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest id.

    Documents without words are linked with nothing and stay."""
    return jaccardjoin.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too.

    Passages are strings of 400 bytes and also stretches of over 50 words, however few bytes these take.
    A null text counts as empty. Passages are judged on this stage's input, so of a passage held by two documents
    neither keeps it. A document of which nothing but white space is left goes; one that was so before stays."""
    return suffixdedup.remove_repeats(docs, words=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in token sequences.

    A null or empty text is one piece, of the end id alone. Which sequence holds a piece is no part of the result."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", remove_repeats),
    ("best_fit_packing", pack),
]

#: SQL can't express the fitted model, zstandard or the tokenizer; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again. An empty table gives no pieces."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
