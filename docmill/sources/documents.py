"""Reading document files and interchange files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.chunking import content_hash
from docmill.session import bound_batches

#: Suffixes that a folder scan takes, in any case.
SUFFIXES = (".txt", ".text", ".md", ".markdown", ".pdf")

#: Characters of parsed pages after which a task hands them on.
PAGES_SIZE = 4 << 20


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def read_files(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source_path, document_id, content, content_hash, argument) of files below the paths, each once; argument
    is the number, from 0, of the first of the paths that it is below or is."""
    roots = []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        roots.append(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/"))
    # a path below another one is listed with that
    outer = [r for k, r in enumerate(roots) if r not in roots[:k] and not any(r.startswith(o + "/") for o in roots)]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(outer)
    wanted = found.where(F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    bare = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/") if not isinstance(c, str) else re.sub("^([a-z0-9]+):/+", r"\1:/", c)
    below = lambda r: (bare(F.col("path")) == bare(r)) | bare(F.col("path")).startswith(bare(r) + "/")
    argument = F.coalesce(*(F.when(below(r), F.lit(k)) for k, r in enumerate(roots)))
    return wanted.select(F.col("path").alias("source_path"), stem(F.col("path")).alias("document_id"), "content", content_hash(F.col("content")).alias("content_hash"), argument.alias("argument"))


def text_pages(files: DataFrame) -> DataFrame:
    """(source_path, page, text, error) of text files; a form feed begins a page."""
    text = F.split(decode(F.coalesce("content", F.lit(b""))), "\f", -1)
    return files.select("source_path", F.posexplode(text).alias("page", "text")).select("source_path", (F.col("page") + 1).alias("page"), "text", F.lit(None).cast("string").alias("error"))


def pages_by(parse: Callable[[str, bytes], list[str]]) -> Callable[[DataFrame], DataFrame]:
    """A parser of files from a function of one file's path and bytes that returns its pages' texts. What it
    raises is that file's error, with no page, and stops no other file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["source_path", "page", "text", "error"])

        for batch in batches:
            rows, size = [], 0
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    texts, error = [str(t) for t in parse(path, content or b"")], None
                except Exception as fault:  # the format's own errors can be of any kind
                    texts, error = [None], f"{type(fault).__name__}: {fault}"
                rows += [(path, k, t, error) for k, t in enumerate(texts, 1)]
                size += sum(len(t or "") for t in texts)
                if size > PAGES_SIZE:
                    yield made()
                    rows, size = [], 0
            if rows:
                yield made()

    def pages(files: DataFrame) -> DataFrame:
        bound_batches(files.sparkSession)
        return files.select("source_path", "content").mapInArrow(run, "source_path string, page int, text string, error string")

    return pages


def route(files: DataFrame, parsers: Sequence[tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(source_path, page, text, error) of files (source_path, content): each goes to the first parser that
    takes its suffix, in any case. A file that none takes has one row with error ``unsupported`` and no page."""
    which = F.coalesce(*(F.when(F.lower("source_path").rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$"), F.lit(k)) for k, (suffixes, _) in enumerate(parsers)), F.lit(-1))
    routed = files.withColumn("_parser", which)
    none = lambda kind: F.lit(None).cast(kind)
    out = routed.where("_parser = -1").select("source_path", none("int").alias("page"), none("string").alias("text"), F.lit("unsupported").alias("error"))
    for k, (_, parse) in enumerate(parsers):
        out = out.unionByName(parse(routed.where(F.col("_parser") == k).drop("_parser")))
    return out


def decode(content: Column) -> Column:
    """UTF-8 with a replacement character for bad bytes."""
    return F.make_valid_utf8(content.cast("string"))


GRADED = "struct<version:int,cases:array<struct<question:string,expected_pages:array<int>,expected_codes:array<string>,should_find:boolean>>>"


def _whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x"))


def read_graded_set(spark: SparkSession, path: str) -> DataFrame:
    """(case_no, question, expected_pages, expected_codes, should_find) of a version-1 graded set."""
    raw = _whole_json(spark, path, GRADED)
    fine = F.when(F.coalesce(F.col("x.version"), F.lit(0)) == 1, F.col("x.cases")).otherwise(F.raise_error("a graded set of version 1 is expected"))
    rows = raw.select(F.posexplode(fine).alias("case_no", "c"))
    question = F.when(F.length(F.trim("c.question")) > 0, F.col("c.question")).otherwise(F.raise_error("a case without a question"))
    empty_i, empty_s = F.array().cast("array<int>"), F.array().cast("array<string>")
    return rows.select(
        "case_no", question.alias("question"), F.coalesce("c.expected_pages", empty_i).alias("expected_pages"), F.coalesce("c.expected_codes", empty_s).alias("expected_codes"), F.coalesce("c.should_find", F.lit(True)).alias("should_find")
    )
