"""Equal questions to an index are asked once, and every query gets what its question found."""

import pytest
from pyspark.sql import functions as F

from docmill.config import RetrievalConfig
from docmill.functions import codes
from docmill.operators import answering, chunking, lifecycle


def _parse(files):
    lines = files.withColumn("line", F.explode(F.split(F.col("content").cast("string"), "\n"))).where("line <> ''")
    return lines.select("source_path", F.md5(F.concat("source_path", "line")).alias("chunk_id"), F.col("line").alias("text"), codes.extract(F.col("line")).alias("codes"))


def _vector(text):
    return F.array(*(F.length(F.regexp_replace(text, f"[^{x}]", "")).cast("double") for x in "abc"))


@pytest.fixture()
def path(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    for now, rows in (("T0", [("a.txt", "alarm 12 aab\nbbc"), ("b.txt", "alarm 12 ccc\nold")]), ("T1", [("a.txt", "alarm 12 aab\nbbc"), ("b.txt", "alarm 12 ccc\ncab"), ("c.txt", "aab alarm 7")])):
        df = spark.createDataFrame([(p, c.encode()) for p, c in rows], "source_path string, content binary")
        lifecycle.update(spark, at, df.withColumn("content_hash", chunking.content_hash(F.col("content"))), _parse, lambda c: c.select("chunk_id", "source_path", _vector("embedding_text").alias("v")), "letters", now)
    return at


def test_equal_questions_are_asked_once(spark, path):
    texts = ["alarm 12 or alarm 99: aab", "bbc", None, ""]
    asked = spark.createDataFrame([(k, texts[k % 4]) for k in range(40)], "query_id long, question string")
    embedded = []

    def embed(rows):
        embedded.append(rows.count())
        return rows.select("query_id", _vector("embedding_text").alias("v"))

    prepared, hits = answering.ask(spark, path, asked, embed, RetrievalConfig(top_k=2, min_score=0.6), model="letters")
    got = {r.query_id: r for r in prepared.collect()}
    assert embedded == [4] and sorted(got) == list(range(40))
    assert all(got[k].question == texts[k % 4] and tuple(got[k])[2:] == tuple(got[k % 4])[2:] for k in got)
    assert got[0].resolved == ["AL-12"] and got[1].resolved == [] and not got[2].found and got[2].matched is None and not got[3].found
    assert [(r.source_path, r.codes) for r in got[0].retrieved][:1] == [("a.txt", ["AL-12"])] and got[0].matched.asDict() == {"code": 1, "semantic": 1, "hybrid": 1}
    rows = {}
    for r in hits.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.source_path, r.chunk_id))
    assert sorted(rows) == sorted(k for k in got if got[k].found)
    assert all([x[1:] for x in sorted(rows[k])] == [(r.source_path, r.chunk_id) for r in got[k].retrieved] for k in rows)


def test_chunks_of_asks_only_for_live_ones(spark, path):
    old = lifecycle.load(spark, path, 1)["chunks"].where("text in ('old', 'bbc', 'alarm 12 ccc')").select("source_path", "chunk_id")
    assert sorted(r.text for r in lifecycle.chunks_of(spark, path, old).collect()) == ["alarm 12 ccc", "bbc"]
    assert sorted(r.text for r in lifecycle.chunks_of(spark, path, old, 1).collect()) == ["alarm 12 ccc", "bbc", "old"]
