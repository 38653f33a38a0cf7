"""The life cycle of an index on small hand-made files."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import chunking, lifecycle, vectorblocks


@pytest.fixture()
def make(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    def files(*rows):
        df = spark.createDataFrame([(p, c.encode()) for p, c in rows], "source_path string, content binary")
        return df.withColumn("content_hash", chunking.content_hash(F.col("content")))
    parse = lambda f: f.withColumn("line", F.explode(F.split(F.col("content").cast("string"), "\n"))).where("line <> ''").select("source_path", F.md5(F.concat("source_path", "line")).alias("chunk_id"), F.col("line").alias("text"))
    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.length("text").cast("double")).alias("v"))
    return path, lambda now, *rows, model="m": lifecycle.update(spark, path, files(*rows), parse, embed, model, now)


def texts(spark, path):
    return sorted(r.text for r in lifecycle.load(spark, path)["chunks"].collect())


def test_only_changes_are_written(spark, make):
    path, update = make
    update("T0", ("x/a.txt", "one\ntwo"), ("x/b.txt", "three"), ("y/c.txt", ""))
    assert lifecycle.summary(spark, path).first().asDict() == {"added": 3, "refreshed": 0, "skipped": 0, "removed": 0, "total_documents": 3, "total_chunks": 3}
    update("T1", ("x/a.txt", "two\nfour"), ("x/b.txt", "three"))
    assert spark.read.parquet(f"{path}/segments/s2/chunks").count() == 2
    assert texts(spark, path) == ["four", "three", "two"]
    row = lifecycle.load(spark, path)["registry"].where("source_path = 'x/a.txt'").first()
    assert (row.chunk_count, row.document_id, row.title, row.segment) == (2, "a", "a", 2)
    update("T2", ("x/b.txt", "three"))
    assert lifecycle.summary(spark, path).first().skipped == 1 and texts(spark, path) == ["four", "three", "two"]
    meta = lifecycle.load(spark, path)["meta"].first()
    assert (meta.created_at, meta.updated_at, meta.vector_dim, meta.total_documents) == ("T0", "T2", 1, 3)


def test_remove(spark, make):
    path, update = make
    with pytest.raises(lifecycle.NoIndex):
        lifecycle.remove(spark, path, ["a"])
    assert lifecycle.load(spark, path) is None
    update("T0", ("x/a.txt", "one"), ("y/a.txt", "two"), ("z/b.txt", "three"))
    assert sorted(r[0] for r in lifecycle.remove(spark, path, ["q/a.txt"], "T1").collect()) == ["x/a.txt", "y/a.txt"]
    assert texts(spark, path) == ["three"] and lifecycle.load(spark, path)["meta"].first().updated_at == "T1"
    update("T2", ("x/a.txt", "one"))
    assert texts(spark, path) == ["one", "three"] and lifecycle.load(spark, path)["vectors"].count() == 2


def test_reembed(spark, make):
    path, update = make
    update("T0", ("x/a.txt", "one\ntwo"), ("x/b.txt", "three"))
    bad = lambda c: c.where("text <> 'two'").select("chunk_id", "source_path", F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(ValueError, match="2 vectors for 3 chunks"):
        lifecycle.reembed(spark, path, bad, "n", "T1")
    assert {len(r.v) for r in lifecycle.load(spark, path)["vectors"].collect()} == {1}
    two = lambda c: c.select("chunk_id", "source_path", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert lifecycle.reembed(spark, path, two, "n", "T2") == 3
    now = lifecycle.load(spark, path)
    assert {len(r.v) for r in now["vectors"].collect()} == {2} and now["meta"].first().embedding_model == "n" and texts(spark, path) == ["one", "three", "two"]
    with pytest.raises(lifecycle.ModelMismatch):
        update("T3", ("x/c.txt", "c"))


def test_segments_are_joined(spark, make, monkeypatch):
    monkeypatch.setattr(lifecycle, "MOST_SEGMENTS", 3)
    path, update = make
    for k in range(4):
        update(f"T{k}", ("x/a.txt", f"text {k}"), (f"x/{k}.txt", f"other {k}"))
    assert texts(spark, path) == ["other 0", "other 1", "other 2", "other 3", "text 3"]
    assert len(lifecycle.load(spark, path)["meta"].first()["segments"]) < 3


def test_a_second_writer_fails(spark, make):
    path, update = make
    update("T0", ("x/a.txt", "one"))
    first, second = lifecycle._Change(spark, path), lifecycle._Change(spark, path)
    registry = lifecycle.load(spark, path)["registry"]
    first.finish(registry, "m", 1, "T1", [1])
    with pytest.raises(lifecycle.ConcurrentChange):
        second.finish(registry, "m", 1, "T1", [1])
    assert texts(spark, path) == ["one"]


def test_no_rows_come_without_python(spark):
    none = lifecycle._none(spark, lifecycle._POSTING + ", bucket long")
    assert none.count() == 0 and [t for _, t in none.dtypes] == ["string", "string", "string", "bigint"]
    assert "RDD" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_placed_once_and_packed_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectorblocks, "BLOCK", 4)
    monkeypatch.setattr(vectorblocks, "TASK_BLOCKS", 2)
    rows = spark.createDataFrame([(f"p{k}", str(k), [1.0, float(k)]) for k in range(40)], "source_path string, chunk_id string, v array<double>")
    kept = []
    blocks = vectorblocks.build(rows, lambda df: kept.append(df.cache()) or kept[0])
    assert len(kept) == 1 and blocks.rdd.getNumPartitions() == 5
    assert sum(len(r.ids) for r in blocks.collect()) == 40
