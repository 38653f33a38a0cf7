"""Search, postings and concurrent changes of a stored index against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.config import RetrievalConfig
from docmill.functions import codes
from docmill.operators import chunking, lifecycle, retrieval, vectorblocks


@pytest.fixture()
def index(spark, tmp_path):
    path = f"file://{tmp_path}/index"

    def files(*rows):
        df = spark.createDataFrame([(p, c.encode()) for p, c in rows], "source_path string, content binary")
        return df.withColumn("content_hash", chunking.content_hash(F.col("content")))

    def parse(f):
        lines = f.withColumn("line", F.explode(F.split(F.col("content").cast("string"), "\n"))).where("line <> ''")
        return lines.select("source_path", F.md5(F.concat("source_path", "line")).alias("chunk_id"), F.col("line").alias("text"), codes.extract(F.col("line")).alias("codes"))

    embed = lambda c: c.select("chunk_id", "source_path", F.array(*(F.length(F.regexp_replace("embedding_text", f"[^{x}]", "")).cast("double") for x in "abc")).alias("v"))
    return path, lambda now, *rows: lifecycle.update(spark, path, files(*rows), parse, embed, "letters", now), embed


def test_two_writers_lose_nothing(spark, index, monkeypatch):
    """The second writer commits between the first one's look at the log and its own log entry."""
    path, update, _ = index
    update("T0", ("a.txt", "a"))
    inner, real = [], lifecycle.create_once

    def late(spark_, at, content):
        if "/log/" in at and not inner:
            inner.append(1)
            update("T1", ("b.txt", "b"), ("a.txt", "a"))
        return real(spark_, at, content)

    monkeypatch.setattr(lifecycle, "create_once", late)
    assert {(r.source_path, r.action) for r in update("T2", ("c.txt", "c"), ("b.txt", "b")).collect()} == {("c.txt", "added"), ("b.txt", "skipped")}
    now = lifecycle.load(spark, path)
    assert sorted(r.text for r in now["chunks"].collect()) == ["a", "b", "c"] and now["vectors"].count() == 3
    assert lifecycle.latest(spark, path) == 3


def test_a_version_is_created_once(spark, tmp_path):
    at = f"file://{tmp_path}/log/1"
    assert lifecycle.create_once(spark, at, "one") and not lifecycle.create_once(spark, at, "two")
    assert spark.read.text(at).first()[0] == "one" and lifecycle._names(spark, f"file://{tmp_path}/log") == ["1"]


def test_changes_write_what_they_change(spark, index):
    path, update, _ = index
    update("T0", ("a.txt", "a"), ("a.txt", "a"), ("b.txt", "b"))
    assert lifecycle.load(spark, path)["registry"].count() == 2 and lifecycle.load(spark, path)["chunks"].count() == 2
    for k in range(9):
        update(f"T{k + 1}", ("a.txt", "a"))
    meta = lifecycle.load(spark, path)["meta"].first()
    assert len(meta.segments) == 1 and meta.updated_at == "T9" and lifecycle.summary(spark, path).first().skipped == 1
    update("T10", ("a.txt", "aa"))
    lifecycle.remove(spark, path, ["b.txt"], "T11")
    assert lifecycle.summary(spark, path).first().asDict() == {"added": 0, "refreshed": 0, "skipped": 0, "removed": 1, "total_documents": 1, "total_chunks": 1}
    update("T12", ("c.txt", "c"))  # joins four segments
    meta = lifecycle.load(spark, path)["meta"].first()
    assert len(meta.segments) == 1 and lifecycle.summary(spark, path).first().added == 1  # the change's own counts
    assert sorted(r.text for r in lifecycle.load(spark, path)["chunks"].collect()) == ["aa", "c"]
    old = lifecycle.load(spark, path, 10)
    lifecycle.vacuum(spark, path, keep=20)
    assert sorted(r.text for r in old["chunks"].collect()) == ["a", "b"]
    assert lifecycle.vacuum(spark, path, keep=1) == [] and lifecycle.vacuum(spark, path, keep=1, older_than=0)
    assert sorted(r.text for r in lifecycle.load(spark, path)["chunks"].collect()) == ["aa", "c"]
    update("T13", ("d.txt", "d"))
    assert lifecycle.load(spark, path)["chunks"].count() == 3


def test_postings_equal_a_rebuild(spark, index):
    path, update, _ = index
    update("T0", ("a.txt", "alarm 12\nstop 3"), ("b.txt", "alarm 12"))
    update("T1", ("a.txt", "alarm 12 and fault 77"), ("c.txt", "no code"))
    lifecycle.remove(spark, path, ["b.txt"])
    now = lifecycle.load(spark, path)
    got = sorted((r.value, r.source_path, r.chunk_id) for r in now["postings"].collect())
    assert got == sorted((r.value, r.source_path, r.chunk_id) for r in retrieval.postings(now["chunks"], "source_path").collect())
    assert [g[0] for g in got] == ["AL-12", "F-77"]


def _brute(queries, rows, k, least):
    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    out = {}
    for q, v in queries:
        found = sorted(((-round(cosine(np.array(v), np.array(w)), 9), i) for i, _, w in rows if w and len(w) == len(v) and None not in w), key=lambda x: x)
        out[q] = [(i, -s) for s, i in found if -s >= least][:k]
    return out


@pytest.mark.parametrize(("least", "sent"), [(-1.0, 1 << 20), (0.6, 1 << 20), (0.6, 0)])
def test_search_skips_blocks_and_finds_all(spark, tmp_path, monkeypatch, least, sent):
    monkeypatch.setattr(vectorblocks, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(vectorblocks, "STEP", 5)
    monkeypatch.setattr(vectorblocks, "BLOCK", 8)
    monkeypatch.setattr(vectorblocks, "PIVOTS", 24)
    monkeypatch.setattr(vectorblocks, "QUERIES", 4)
    monkeypatch.setattr(vectorblocks, "BOUNDS", 16)
    draw = random.Random(5)
    middles = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(24)]
    rows = [(f"c{k:04d}", f"p{k % 7}", [x + draw.gauss(0, 0.05) for x in middles[k % 24]]) for k in range(600)]
    rows += [("twin2", "p1", rows[0][2]), ("twin1", "p2", rows[0][2]), ("zero", "p1", [0.0] * 6), ("null", "p1", None), ("hole", "p1", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("short", "p1", [1.0, 2.0]), ("empty", "p1", [])]
    rows += [("old", "gone", rows[0][2]), ("old2", "gone", rows[1][2])]
    df = spark.createDataFrame(rows, "chunk_id string, source_path string, v array<double>")
    queries = [(k, rows[k * 3][2]) for k in range(20)] + [(90, [0.0] * 6), (91, [3.0, 4.0]), (92, None)]

    def keep(frame, what):
        at = f"{tmp_path}/{what}-{random.random()}"
        frame.write.parquet(at)
        return spark.read.parquet(at)

    blocks = keep(vectorblocks.build(df).withColumn("segment", F.lit(1)), "blocks")
    assert vectorblocks.unpack(blocks).count() == len(rows)
    dead = spark.createDataFrame([(1, "gone"), (2, "p1")], "segment int, source_path string")
    hits, work = vectorblocks.search(blocks, spark.createDataFrame(queries, "query_id long, v array<double>"), RetrievalConfig(top_k=5, min_score=least), keep, dead)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    want = _brute([q for q in queries if q[1]], [r for r in rows if r[1] != "gone"], 5, least)
    assert got == {q: w for q, w in want.items() if w}
    done = work.first()
    assert done.scored < done.block_pairs


def test_search_over_the_index(spark, index):
    path, update, embed = index
    update("T0", ("a.txt", "aab\nabc"), ("b.txt", "ccc"))
    update("T1", ("a.txt", "aab\nbbb"), ("d.txt", ""))
    asked = spark.createDataFrame([("q1", [2.0, 1.0, 0.0]), ("q2", [0.0, 0.0, 1.0])], "query_id string, v array<double>")
    hits, _ = lifecycle.search(spark, path, asked, RetrievalConfig(top_k=2, min_score=0.2))
    text = {r.chunk_id: r.text for r in lifecycle.load(spark, path)["chunks"].collect()}
    assert [(r.query_id, text[r.chunk_id], r["rank"]) for r in hits.orderBy("query_id", "rank").collect()] == [("q1", "aab", 1), ("q1", "bbb", 2), ("q2", "ccc", 1)]
    assert lifecycle.model_warning(spark, path, "other") and lifecycle.model_warning(spark, path, "letters") is None
    with pytest.raises(lifecycle.NoIndex):
        lifecycle.search(spark, path + "x", asked, RetrievalConfig())
