"""Preparing questions and assembling answers on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from docmill.config import NOT_FOUND
from docmill.functions import answers
from docmill.operators import answering

OFFERED = ["aaaaaa", "bbbbbb", "cccccc", "dddddd"]


@pytest.fixture(scope="module")
def prepared(spark):
    questions = spark.createDataFrame([(k, f"q{k}") for k in range(10)], "query_id long, question string")
    hits = spark.createDataFrame([(k, r, c) for k in range(9) for r, c in enumerate(OFFERED)] + [(1, 9, "gone")], "query_id long, rank int, chunk_id string")
    chunks = spark.createDataFrame([(c, f"p{k // 2}", 1, None if k < 2 else "S", "paragraph", f"text {k}", [f"AL-{k}", "SC-1"]) for k, c in enumerate(OFFERED)], "chunk_id string, source_path string, page int, section string, kind string, text string, codes array<string>")
    resolved = spark.createDataFrame([(3, 1, "F-22"), (3, 0, "F-11")], "query_id long, position int, value string")
    return answering.prepare(questions, hits, chunks, resolved)


def test_prepare(spark, prepared):
    rows = {r.query_id: r for r in prepared.collect()}
    assert not rows[9].found and rows[9].messages is None and rows[9].resolved == []
    assert [r.chunk_id for r in rows[1].retrieved] == OFFERED and rows[3].resolved == ["F-11", "F-22"]
    assert rows[0].messages[0].role == "system" and rows[0].messages[1].content.startswith("Question: q0\n\nContext passages:\n\n[aaaaaa]\nIdentifiers: AL-0, SC-1\ntext 0\n\n[bbbbbb]")


def test_assemble(spark, prepared):
    replies = [
        (0, " see [cccccc] and bbbbbb "), (1, "no ids"), (2, f"Sadly {NOT_FOUND}"), (3, '{"found": false, "steps": ["1. a", 2, null, true, " "], "used": ["[bbbbbb]", "bbbbbb", 7, "zz"]}'),
        (4, '{"found": true, "answer": 5}'), (5, 'text {"answer":"k"} and } more'), (6, '```json\n{"answer": "k"}\n```'), (7, None), (9, "anything"),
    ]
    got = {r.query_id: r for r in answering.assemble(prepared, spark.createDataFrame(replies, "query_id long, reply string"), structured=True).collect()}
    ids = lambda k: [c.chunk_id for c in got[k].citations]
    assert ids(0) == ["cccccc", "bbbbbb"] and got[0].text == "see [cccccc] and bbbbbb" and got[0].referenced == ["AL-0", "SC-1", "AL-1", "AL-2", "AL-3"]
    assert ids(1) == OFFERED[:3] and tuple(got[1].citations[2]) == ("cccccc", "p1", 1, "S")
    assert not got[2].found and got[2].text == NOT_FOUND and got[2].citations == [] and got[2].referenced == []
    assert got[3].found and got[3].text == "1. a\n2. 2\n3. None\n4. True" and ids(3) == ["bbbbbb", "bbbbbb"] and got[3].referenced == ["F-11", "F-22"]
    assert not got[4].found and got[5].text == 'text {"answer":"k"} and } more' and got[6].text == "k" and ids(6) == OFFERED[:3]
    assert got[7].found and got[7].text == "" and got[8].text == "" and not got[9].found
    plain = {r.query_id: r for r in answering.assemble(prepared, spark.createDataFrame(replies, "query_id long, reply string")).collect()}
    assert plain[6].text.startswith("```json") and plain[4].found
    places = sorted(tuple(r) for r in answering.provenance(answering.assemble(prepared, spark.createDataFrame(replies[:2], "query_id long, reply string"))).where("query_id < 2").collect())
    assert places == [(0, 0, "p1", 1, "S"), (0, 1, "p0", 1, None), (1, 0, "p0", 1, None), (1, 2, "p1", 1, "S")]
    assert answering.assemble(prepared.limit(0), spark.createDataFrame(replies, "query_id long, reply string")).count() == 0


@pytest.mark.parametrize(
    ("reply", "found", "used"),
    [('{"found": null}', False, []), ('{"found": 0}', False, []), ('{"found": 0.0}', False, []), ('{"found": ""}', False, []), ('{"found": []}', False, []), ('{"found": "false"}', True, []), ('{"answer": 5}', True, []), ('{"used": ["[[aaaaaa]", "aaaaaa"], "steps": 4}', True, ["aaaaaa", "aaaaaa"]), ('x {"found": true} y', True, [])],
)
def test_structured_fields(spark, reply, found, used):
    row = spark.createDataFrame([(reply, OFFERED)], "r string, o array<string>").select(answers.parse_structured(F.col("r"), F.col("o")).alias("p")).first().p
    assert (row.found, row.answer, row.steps, row.used) == (found, "", [], used)


@pytest.mark.parametrize("reply", ["", "{broken", '[1, 2]', '"x"', 'a {"b": 1} {"c": 2}', '{"a": 1} tail }', None])
def test_no_structured_reply(spark, reply):
    assert spark.createDataFrame([(reply, OFFERED)], "r string, o array<string>").select(answers.parse_structured(F.col("r"), F.col("o")).alias("p")).first().p is None
