"""The index as one JSON document: ranges of any length, any layout, round trips."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.operators import lifecycle
from docmill.sources import indexjson
from docmill.sources.indexjson import read_index_json

ODD = ['plain', 'a,b,,c', '{"chunks": [', '\\', 'x\\\\",', '"', '"vectors": {,', ']}', '\n,\t', 'é,—', '', 'chunk_id']


def _index(n, seed):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(ODD) for _ in range(draw.randrange(4)))
    chunks = [
        {"chunk_id": f"c{k}", "document_id": text(), "source_path": f"d{k % 5}/{draw.choice(ODD[:2])}", "text": text(), "page": k, "section": text(), "kind": "table",
         "codes": [{"kind": "alarm", "value": text(), "raw": text()} for _ in range(k % 3)], "rows": [[text(), text()], []] if k % 2 else None}
        for k in range(n)
    ]
    paths = sorted({c["source_path"] for c in chunks})
    documents = [{"source_path": p, "document_id": text(), "title": text(), "content_hash": text(), "chunk_count": 3} for p in paths]
    return {"version": 2, "metadata": {"embedding_model": "m,{", "vector_dim": 2, "created_at": "T0", "updated_at": "T1", "documents": documents}, "chunks": chunks, "vectors": {c["chunk_id"]: [k, -k / 7] for k, c in enumerate(chunks)}}


def _turned(value):
    """The same with every object's keys in the opposite order."""
    if isinstance(value, dict):
        return {k: _turned(value[k]) for k in reversed(value)}
    return [_turned(v) for v in value] if isinstance(value, list) else value


def _read(spark, path):
    got = read_index_json(spark, f"file://{path}")
    chunks = sorted((r.asDict(recursive=True) for r in got["chunks"].collect()), key=lambda c: int(c["chunk_id"][1:]))
    return {"chunks": chunks, "vectors": {r.chunk_id: list(r.v) for r in got["vectors"].collect()}, "registry": sorted((r.asDict() for r in got["registry"].collect()), key=lambda d: d["source_path"]), "meta": got["meta"].first().asDict()}


@pytest.fixture
def ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def _cut(text, size):
    """Entries (section, text) of a text whose ranges hold what begins in them, as the text source deals it."""
    ranges, at = {}, 0
    for piece in text.split(b","):
        ranges.setdefault(at // size * size, []).append(piece)
        at += len(piece) + 1
    batch = lambda start, own: pa.RecordBatch.from_arrays([pa.array(["f"] * len(own)), pa.array([start] * len(own)), pa.array(own, pa.binary())], names=["file", "start", "value"])
    halves = lambda start, own: [batch(start, own[: len(own) // 2]), batch(start, own[len(own) // 2 :])]
    begins = indexjson._begins([r for start, own in ranges.items() for b in indexjson._survey(halves(start, own)) for r in b.to_pylist()])
    entries = []
    for start, own in ranges.items():
        for r in (r for b in indexjson._entries(begins)(halves(start, own)) for r in b.to_pylist()):
            if r["opens"]:
                entries.append((r["section"], r["text"]))
            else:
                entries[-1] = (entries[-1][0], entries[-1][1] + r["text"])
    return entries


@pytest.mark.parametrize("layout", ["plain", "tight", "lines", "turned"])
def test_every_length_of_range_gives_the_same_entries(layout):
    for size in (1, 2, 7, 19, 40, 61, 97, 150, 333, 1000, 10**6):
        want = _index(9, size)
        style = {"tight": {"separators": (",", ":")}, "lines": {"indent": 2, "ensure_ascii": False}}.get(layout, {})
        entries = _cut(json.dumps(_turned(want) if layout == "turned" else want, **style).encode(), size)
        assert [json.loads(t) for s, t in entries if s == "chunks"] == want["chunks"]
        assert [json.loads(t) for s, t in entries if s == "documents"] == want["metadata"]["documents"]
        members = {}
        for s, t in entries:
            if s in ("vectors", "version", "metadata"):
                members |= json.loads("{" + t + "}")
        assert members == want["vectors"] | {"version": 2} | {k: v for k, v in want["metadata"].items() if k != "documents"}


@pytest.mark.parametrize(("size", "layout"), [(233, "turned"), (1 << 20, "lines")])
def test_a_document_is_read_in_ranges(spark, tmp_path, ranges, size, layout):
    want = _index(7, size)
    style = {"indent": 2, "ensure_ascii": False} if layout == "lines" else {}
    path = tmp_path / "index.json"
    path.write_text(json.dumps(_turned(want) if layout == "turned" else want, **style), encoding="utf-8")
    ranges(size)
    if size < 1000:
        assert spark.read.option("lineSep", ",").text(f"file://{path}").rdd.getNumPartitions() > 10
    got = _read(spark, path)
    assert got["chunks"] == want["chunks"]
    assert got["vectors"] == want["vectors"]
    names = want["metadata"].copy()
    assert got["registry"] == names.pop("documents")
    assert got["meta"] == names


def test_version_1_repeated_ids_and_faults(spark, tmp_path, ranges):
    ranges(200)
    path = tmp_path / "i.json"
    chunk = lambda cid, text: {"chunk_id": cid, "document_id": "d", "source_path": "p", "text": text, "page": 1, "section": "", "kind": "paragraph"}
    path.write_text('{"version": 1, "chunks": ' + json.dumps([chunk("c1", "old"), chunk("c2", "x"), chunk("c1", "new")]) + ', "vectors": {"c1": [1], "c1": [2.5, NaN], "c2": []}, "more": {"a": [1, {"b": 2}]}}\n')
    got = _read(spark, path)
    assert [c["text"] for c in got["chunks"]] == ["new", "x"] and got["registry"] == []
    assert got["vectors"]["c1"][0] == 2.5 and got["vectors"]["c1"][1] != got["vectors"]["c1"][1] and got["vectors"]["c2"] == []
    assert got["meta"] == {"embedding_model": "", "vector_dim": None, "created_at": "", "updated_at": ""}
    path.write_text('{"version": 2, "metadata": null, "chunks": [], "vectors": {}}')
    assert _read(spark, path)["chunks"] == []
    for text, error in (('{"version": 3, "chunks": [], "vectors": {}}', "version 3"), ('{"chunks": []}', "version None"), ('{"version": 2, "chunks": [{"chunk_id": "a', "ends inside")):
        path.write_text(text)
        with pytest.raises(ValueError, match=error):
            _read(spark, path)
    path.write_text('{"version": 2, "chunks": [{"chunk_id": oops}], "vectors": {}}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        _read(spark, path)


@pytest.mark.parametrize("one_file", [True, False])
def test_export_is_json_and_comes_back(spark, tmp_path, one_file):
    path, target, copy = f"file://{tmp_path}/index", f"file://{tmp_path}/out.json", f"file://{tmp_path}/copy"
    rows = [("a/x.txt", 'see "W-12", {'), ("a/y.txt", "line\ntwo \\"), ("b.txt", ""), ("gone.txt", "no")]
    files = lambda some: spark.createDataFrame([(p, t.encode(), t) for p, t in some], "source_path string, content binary, content_hash string")

    def parse(f):
        text = F.col("content").cast("string")
        code = F.array(F.struct(F.lit("warning").alias("kind"), F.lit("W-12").alias("value"), F.lit("W 12").alias("raw")))
        return f.where(text != "").select("source_path", F.md5("content").alias("chunk_id"), text.alias("text"), code.alias("codes"))

    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.length("text").cast("double"), F.lit(0.25)).alias("v"))
    lifecycle.update(spark, path, files(rows), parse, embed, "m", "T0")
    lifecycle.remove(spark, path, ["gone.txt"], "T1")
    lifecycle.export_json(spark, path, target, one_file=one_file)
    at = tmp_path / "out.json"
    data = json.loads(at.read_text() if one_file else "".join(p.read_text() for p in sorted(at.glob("part-*"))))
    assert data["version"] == 2 and data["metadata"]["embedding_model"] == "m" and data["metadata"]["updated_at"] == "T1"
    assert [(d["source_path"], d["chunk_count"], d["title"]) for d in data["metadata"]["documents"]] == [("a/x.txt", 1, "x"), ("a/y.txt", 1, "y"), ("b.txt", 0, "b")]
    assert [(c["source_path"], c["text"], c["page"], c["section"], c["rows"]) for c in data["chunks"]] == [(*r, 1, "", None) for r in rows[:2]]
    assert [data["vectors"][c["chunk_id"]] for c in data["chunks"]] == [[13.0, 0.25], [10.0, 0.25]]
    assert lifecycle.import_json(spark, target, copy) == 1
    old, new = lifecycle.load(spark, path), lifecycle.load(spark, copy)
    for name in ("registry", "vectors", "postings"):
        columns = [c for c in new[name].columns if c not in ("segment", "bucket")]
        assert sorted(map(str, new[name].select(columns).collect())) == sorted(map(str, old[name].select(columns).collect())), name
    assert new["meta"].select("embedding_model", "vector_dim", "created_at", "updated_at", "total_chunks").first() == ("m", 2, "T0", "T1", 2)
    skipped = lifecycle.update(spark, copy, files(rows[:3]), parse, embed, "m", "T2").select("action").distinct().collect()
    assert [r.action for r in skipped] == ["skipped"]


def test_an_empty_index_comes_back(spark, tmp_path):
    path, target = f"file://{tmp_path}/index", f"file://{tmp_path}/out.json"
    none = spark.createDataFrame([], "source_path string, content binary, content_hash string")
    lifecycle.update(spark, path, none, lambda f: f, lambda c: c, "m", "T0")
    lifecycle.export_json(spark, path, target, one_file=True)
    data = json.loads((tmp_path / "out.json").read_text())
    assert data["chunks"] == [] and data["vectors"] == {} and data["metadata"]["documents"] == []
    lifecycle.import_json(spark, target, path + "2")
    assert lifecycle.load(spark, path + "2")["registry"].count() == 0
