"""Listing, routing, model calls and graded sets on small hand-made input."""

import json

import pytest
from pyspark.sql import functions as F

from docmill.operators import evaluate, lifecycle, modelcalls
from docmill.sources import documents


def test_files_are_listed_once_and_know_their_argument(spark, tmp_path):
    for name in ("b/x.txt", "b/in/y.MD", "a/z.txt", "a/no.bin", "aa/w.text"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)
    got = documents.read_files(spark, f"{tmp_path}/b/in", f"file://{tmp_path}/a", f"{tmp_path}/b/", f"{tmp_path}/aa/w.text", f"{tmp_path}/a")
    rows = sorted((r.argument, r.source_path.rsplit("/", 1)[1], r.document_id, bytes(r.content).decode()) for r in got.collect())
    assert rows == [(0, "y.MD", "y", "b/in/y.MD"), (1, "z.txt", "z", "a/z.txt"), (2, "x.txt", "x", "b/x.txt"), (3, "w.text", "w", "aa/w.text")]


def test_every_file_has_an_outcome(spark):
    def numbers(path, content):
        return [str(int(x)) for x in content.split()]

    rows = [("a.txt", b"one\x0ctwo"), ("b.TXT", b"\xff\xfe"), ("c.num", b"1 22"), ("d.num", b"1 x"), ("e.num", b""), ("f.bin", b"?"), ("g", None), ("h.txt", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "source_path string, content binary")
    got = documents.route(df, [((".txt",), documents.text_pages), ((".num",), documents.pages_by(numbers))])
    out = {}
    for r in got.orderBy("source_path", "page").collect():
        out.setdefault(r.source_path, []).append(r.text if r.error is None else r.error.split(":")[0])
    assert out == {"a.txt": ["one", "two"], "b.TXT": ["��"], "c.num": ["1", "22"], "d.num": ["ValueError"], "f.bin": ["unsupported"], "g": ["unsupported"], "h.txt": [""]}


def test_a_failed_file_keeps_what_the_index_held(spark, tmp_path):
    path = f"file://{tmp_path}/index"

    def files(*rows):
        return spark.createDataFrame([(p, c.encode(), c) for p, c in rows], "source_path string, content binary, content_hash string")

    def parse(f):
        text = F.col("content").cast("string")
        return f.select("source_path", F.md5("content").alias("chunk_id"), text.alias("text"), F.when(text == "bad", "broken").alias("error"))

    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.lit(1.0)).alias("v"))
    update = lambda *rows: {r.source_path: r.action for r in lifecycle.update(spark, path, files(*rows), parse, embed, "m").collect()}
    assert update(("a", "good"), ("b", "bad")) == {"a": "added", "b": "failed"}
    assert [tuple(r) for r in lifecycle.failures(spark, path).collect()] == [("b", "broken")]
    assert update(("a", "bad"), ("b", "fine")) == {"a": "failed", "b": "added"}
    assert sorted(r.text for r in lifecycle.load(spark, path)["chunks"].collect()) == ["fine", "good"]
    assert update(("a", "bad")) == {"a": "failed"} and lifecycle.load(spark, path)["registry"].count() == 2


def test_calls_are_made_once_and_outlive_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(modelcalls, "PORTION", 10)
    monkeypatch.setattr(modelcalls, "BATCH", 4)
    log, flag, store = tmp_path / "log", tmp_path / "broken", f"file://{tmp_path}/store"
    log.mkdir()

    def call(texts):
        import os
        import uuid

        if os.path.exists(flag) and "t17" in texts:
            raise RuntimeError("the model is gone")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [None if t == "t3" else t.upper() for t in texts]

    asked = spark.createDataFrame([(k, f"t{k % 40}") for k in range(80)] + [(99, None)], "id long, payload string")
    flag.write_text("")
    with pytest.raises(Exception, match="the model is gone"):
        modelcalls.ask(spark, store, asked, call, "m")
    before = modelcalls.progress(spark, store, asked, "m").first()
    flag.unlink()
    got = {r.id: r.result for r in modelcalls.ask(spark, store, asked, call, "m").collect()}
    assert got == {k: None if k % 40 == 3 else f"T{k % 40}" for k in range(80)} | {99: None}
    assert 0 < before.done < before.total == 40
    said = [t for f in log.iterdir() for t in f.read_text().split("\n")]
    again = len(said) - 40  # only what one portion had asked when it failed
    assert set(said) == {f"t{k}" for k in range(40)} and again <= 16
    modelcalls.ask(spark, store, asked, call, "m")
    assert len([t for f in log.iterdir() for t in f.read_text().split("\n")]) == len(said)
    assert modelcalls.progress(spark, store, asked, "other").first().done == 0


def test_a_graded_set_from_its_file(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"version": 1, "cases": [{"question": "q0", "expected_pages": [2], "expected_codes": ["AL-1", "F-2"]}, {"question": "q1", "should_find": False}, {"question": "q2", "expected_codes": ["AL-1"]}]}))
    cases = documents.read_graded_set(spark, f"file://{tmp_path}/set.json").withColumnRenamed("case_no", "query_id")
    hit = "array<struct<page:int,codes:array<string>>>"
    prepared = spark.createDataFrame([(0, True, [(1, ["F-2"]), (2, None)], ["AL-1"]), (1, False, None, [])], f"query_id int, found boolean, retrieved {hit}, resolved array<string>")
    got = evaluate.graded(cases, prepared)
    assert [(r.found_correct, r.page_hit, r.codes_resolved) for r in got.orderBy("query_id").collect()] == [(True, True, True), (True, None, None), (False, None, False)]
