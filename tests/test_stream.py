"""Files that come, are rewritten in place, put back or taken away between runs of the stream."""

import os

import pytest
from pyspark.sql import functions as F

from docmill.operators import lifecycle
from docmill.streaming.ingest import ingest_stream


def _put(at, text, when):
    at.write_text(text)
    os.utime(at, (when, when))


def test_a_rewritten_file_is_seen(spark, tmp_path):
    folder, opened = tmp_path / "in", tmp_path / "opened"
    (folder / "sub").mkdir(parents=True)
    opened.mkdir()
    index, checkpoint = f"file://{tmp_path}/ix", f"file://{tmp_path}/cp"

    def parse(files):
        names = [r.source_path.rsplit("/", 1)[1] for r in files.select("source_path").collect()]
        (opened / str(len(list(opened.iterdir())))).write_text(",".join(sorted(names)))
        return files.select("source_path", F.md5("content").alias("chunk_id"), F.col("content").cast("string").alias("text"))

    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.lit(1.0)).alias("v"))

    def run():
        query = ingest_stream(spark, f"file://{folder}", index, checkpoint, parse, embed)
        query.awaitTermination(120)
        assert query.exception() is None
        texts = {r.source_path.rsplit("/", 1)[1]: r.text for r in lifecycle.load(spark, index)["chunks"].collect()}
        return texts, (opened / str(len(list(opened.iterdir())) - 1)).read_text(), lifecycle.latest(spark, index)

    _put(folder / "odd [1].txt", "one", 1000)
    _put(folder / "sub" / "b.md", "two", 1000)
    _put(folder / "c.bin", "no", 1000)
    texts, parsed, first = run()
    assert texts == {"odd [1].txt": "one", "b.md": "two"} and parsed == "b.md,odd [1].txt"
    _put(folder / "odd [1].txt", "ONE", 2000)  # the same length, another time
    texts, parsed, second = run()
    assert texts == {"odd [1].txt": "ONE", "b.md": "two"} and parsed == "odd [1].txt"
    assert run()[2] == second  # nothing has moved, so there is no new version
    _put(folder / "sub" / "b.md", "two!", 1000)  # the same time, another length
    _put(folder / "odd [1].txt", "one", 1000)  # put back
    _put(folder / "new.txt", "three", 500)  # older than what was seen
    texts, parsed, _ = run()
    assert texts == {"odd [1].txt": "one", "b.md": "two!", "new.txt": "three"} and parsed == "b.md,new.txt,odd [1].txt"


def test_a_failed_batch_is_repeated(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _put(folder / "a.txt", "one", 1000)
    index, checkpoint, fails = f"file://{tmp_path}/ix", f"file://{tmp_path}/cp", [True]

    def parse(files):
        if fails.pop() if fails else False:
            raise RuntimeError("broken parser")
        return files.select("source_path", F.md5("content").alias("chunk_id"), F.col("content").cast("string").alias("text"))

    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(Exception, match="broken parser"):
        ingest_stream(spark, f"file://{folder}", index, checkpoint, parse, embed).awaitTermination(120)
    (folder / "a.txt").unlink()
    _put(folder / "b.txt", "two", 1000)
    ingest_stream(spark, f"file://{folder}", index, checkpoint, parse, embed).awaitTermination(120)
    assert [r.text for r in lifecycle.load(spark, index)["chunks"].collect()] == ["two"]
