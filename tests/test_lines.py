"""Lines, titles and vectors name what is costly once, and give what a plain pass over a text gives."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.functions import codes
from docmill.functions import text as T
from docmill.jobs import workflows
from docmill.operators import blocks as B
from docmill.sources import indexjson

SIGNS = ["a", "B", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "​", "#", "\U0001d400", ""]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_and_strip_are_those_of_plain_strings(spark):
    draw = random.Random(3)
    texts = ["", "\n", "\n\n", "a\n", "a\r\n", "\r\n"] + ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(9))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.lines(F.col("t")).alias("l"), T.strip(F.col("t")).alias("s")).collect()
    assert [(r.l, r.s) for r in got] == [(r.t.splitlines(), r.t.strip()) for r in got]


def test_lines_are_cut_once():
    assert str(T.lines(F.col("t"))).count("split(") == 1


def test_a_blank_line_is_told_without_its_kind(spark):
    files = spark.createDataFrame([("p", bytearray(b"One\n \nTWO"))], "source_path string, content binary")
    got = workflows._parse(files)
    assert sorted(r.text for r in got.collect()) == ["One", "TWO"]
    assert "RLIKE(s" not in _plan(got) and "navigation" not in _plan(got)


TITLED = {1: "x\n# One #\nTWO", 2: "| --- | --- |", 3: "plain\n", 4: " \n", 5: "a | b\n\nLOUD", 6: "", 7: "INTRO - - - - 1-1", 8: "| --- | --- |\n#  Late"}


def test_titles_of_lines_are_those_of_blocks(spark):
    docs = spark.createDataFrame([(k, 1, t) for k, t in TITLED.items()] + [(1, 0, "# Earlier"), (None, 1, "# None")], "d long, page int, text string")
    lines = B.classify(B.page_lines(docs, "d"))
    got = {r.d: r.title for r in B.line_titles(lines, "d").collect()}
    assert got == {r.d: r.title for r in B.titles(B.blocks(lines, "d"), "d").collect()}
    assert got[1] == "Earlier" and got[3] == "3" and got[5] == "LOUD" and not {2, 4, 6, 7} & set(got)


def test_titles_shuffle_no_lines(spark):
    plan = workflows.document_titles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_a_vector_makes_its_checksum_once(spark):
    column, texts = workflows._digest_vector(F.col("t")), spark.createDataFrame([("abc",)], "t string").repartition(1)
    assert "md5" not in _plan(texts.select(column.alias("v"))).split("lambdafunction(", 1)[1]
    row = texts.select(column.alias("v"), F.md5("t").alias("m")).first()
    assert row.v == ["0123456789abcdef".index(d) + 1 - 8.5 for d in row.m[:16]]


def test_lengths_not_texts_are_joined(spark):
    index = {
        "chunks": spark.createDataFrame([("p", "c", "abc"), ("p", "d", None), ("q", "e", "z")], "source_path string, chunk_id string, text string").repartition(2),
        "vectors": spark.createDataFrame([("p", "c", [3.0]), ("p", "d", [1.0])], "source_path string, chunk_id string, v array<double>").repartition(2),
    }
    assert [tuple(r) for r in workflows._held(index).collect()] == [("p", 3, 4)]
    join = _plan(workflows._held(index)).split("Join Inner", 1)[1]
    assert "length(text" in join


def test_a_text_without_identifiers_is_looked_at_once(spark):
    rows = spark.createDataFrame([("none",), ("ALARM 12 and alm-7b",), (None,)], "t string").select(codes.extract(F.col("t"), codes.DEFAULT_CODE_PATTERNS[:1]).alias("c"))
    assert "RLIKE" in _plan(rows)
    assert [[x.value for x in r.c] for r in rows.collect()] == [[], ["AL-12", "AL-7B"], []]


@pytest.mark.parametrize("files", [["a"], ["a", "a", "a"], ["a", "b", "b", "a"]])
def test_ranges_join_their_rows(files):
    values = [f"{k}é".encode() if k % 2 else b"" for k in range(len(files))]
    batch = pa.RecordBatch.from_arrays([pa.array(files), pa.array([0] * len(files)), pa.array(values, pa.binary())], names=["file", "start", "value"])
    want = []
    for f, v in zip(files, values, strict=True):
        want = want[:-1] + [(f, want[-1][1] + v + b",")] if want and want[-1][0] == f else [*want, (f, v + b",")]
    assert [(place[0], data.tobytes()) for place, data in indexjson._ranges([batch])] == want
    assert not list(indexjson._ranges([batch.slice(0, 0)]))


def test_a_line_between_plain_signs_is_not_trimmed(spark, monkeypatch):
    monkeypatch.setattr(T, "SPACES", "xé")  # whatever is trimmed shows
    got = spark.createDataFrame([("x a x",), ("éax",), ("xaé",), ("x",), ("",)], "t string").select(T.strip(F.col("t"))).collect()
    assert [r[0] for r in got] == ["x a x", "a", "a", "x", ""]


def test_a_text_is_searched_for_other_line_ends_alone(spark):
    assert str(T.lines(F.col("t"))).count("regexp_replace(") == 1


def test_routed_files_are_parsed_once(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"

    def parse(path, content):
        with open(seen, "a") as f:
            f.write(path + "\n")
        return ["one\n\ntwo"] if content else 1 / 0

    monkeypatch.setattr(workflows, "_odd_file", parse)
    spark.createDataFrame([(4, "s", "text"), (14, "s", None), (1, "s", " a\nb"), (3, "s", "x")], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source_path: (r.action, r.error, r.chunk_count) for r in workflows.index_routing(spark, f"file://{tmp_path}").collect()}
    assert got == {"s/4.PDF": ("added", None, 2), "s/14.PDF": ("failed", "ZeroDivisionError: division by zero", None), "s/1.txt": ("added", None, 2), "s/3.bin": ("failed", "unsupported", None)}
    assert sorted(seen.read_text().split()) == ["s/14.PDF", "s/4.PDF"]
