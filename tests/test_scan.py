"""Blocks and chunks of tiles of any size against a plain pass over each document's lines."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.config import ChunkingConfig
from docmill.operators import blocks as B
from docmill.operators import chunking

SORTS = ["paragraph one", "and two", "", "HEAD LINE", "# Marked", "1. go", "a | b", "| --- | --- |", "INTRO - - - - 1-1"]
KINDS = {"paragraph one": "paragraph", "and two": "paragraph", "": "blank", "HEAD LINE": "heading", "# Marked": "heading", "1. go": "step", "a | b": "table", "| --- | --- |": "table", "INTRO - - - - 1-1": "navigation"}


def _plain_blocks(lines):
    """[(island, kind, page, lines, section)] of [(page, line)]."""
    out, island, last, section = [], 0, None, None
    for page, line in lines:
        kind = KINDS[line]
        if not (last == (page, kind) and kind in ("paragraph", "table")):
            island += 1
        last = (page, kind)
        if kind == "heading":
            section = line.removeprefix("# ")
        if kind in ("blank", "navigation"):
            continue
        if not out or out[-1][0] != island:
            out.append((island, kind, page, [], section))
        if line != "| --- | --- |":
            out[-1][3].append(line.removeprefix("# "))
    return [b for b in out if b[3]]


def _plain_chunks(blocks, config):
    """[(kind, page, section, text)]"""
    out, sort, group = [], None, []

    def text(b):
        return ("\n" if b[1] == "table" else " ").join(b[3])

    def close():
        nonlocal group
        if group:
            kinds = [b[1] for b in group]
            kind = "table" if "table" in kinds else "step" if set(kinds) == {"step"} else "paragraph"
            out.append((kind, group[0][2], group[0][4], "\n".join(map(text, group))))
        group = []

    for b in blocks:
        now = "heading" if b[1] == "heading" else "table" if b[1] == "table" and config.keep_tables_intact else "steps" if b[1] == "step" and config.keep_steps_intact else "text"
        most = config.step_max_chars if now == "steps" else config.max_chars
        if now != sort or now in ("table", "heading") or sum(len(text(x)) for x in group) + len(text(b)) > most:
            close()
        sort = now
        if now != "heading":
            group.append(b)
    close()
    return out


@pytest.mark.parametrize("tile", [1, 3, 4096])
@pytest.mark.parametrize("intact", [True, False])
def test_tiles_of_any_size_give_the_same_blocks_and_chunks(spark, tile, intact):
    draw, rows, docs = random.Random(tile), [], {}
    for d in range(25):
        lines, last = [], "paragraph one"
        for page in range(1, draw.randrange(1, 5)):
            for n in range(draw.randrange(0, 30)):
                last = last if draw.random() < 0.5 else draw.choice(SORTS)
                lines.append((page, last))
                rows.append((f"d{d}", page, 2 * n - 5, last))  # gaps, and numbers below zero
        docs[f"d{d}"] = _plain_blocks(lines)
    draw.shuffle(rows)
    made = B.blocks(B.classify(spark.createDataFrame(rows, "d string, page int, line_no int, line string")), "d", tile)
    got = sorted((r.d, r.island, r.kind, r.page, r.text, r.section, r.block_no) for r in made.collect())
    want = [(d, b[0], b[1], b[2], ("\n" if b[1] == "table" else " ").join(b[3]), b[4], n) for d, own in docs.items() for n, b in enumerate(own)]
    assert got == sorted(want, key=lambda x: x[:2])
    config = ChunkingConfig(max_chars=40, step_max_chars=15, keep_tables_intact=intact, keep_steps_intact=intact)
    got = sorted((r.d, r.ordinal, r.kind, r.page, r.section, r.text) for r in chunking.chunks(made, "d", config).collect())
    assert got == sorted((d, n, *c) for d, own in docs.items() for n, c in enumerate(_plain_chunks(own, config)))


def test_one_document_lies_in_many_tasks(spark):
    n = 200_000
    lines = spark.range(n).select(F.lit("d").alias("d"), F.lit(1).alias("page"), F.col("id").alias("line_no"), F.when(F.col("id") % 1000 == 0, "HEAD LINE").otherwise("words go on").alias("line"))
    placed = B.placed(B.classify(lines), "d")
    assert placed.agg(F.max("island")).first()[0] == n // 1000 * 2
    widest = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert widest[1] > 1 and widest[0] < n
    made = B.blocks(B.classify(lines), "d")
    assert made.where("kind = 'paragraph'").agg(F.count("*"), F.min(F.length("text")), F.max(F.length("text"))).first()[:] == (n // 1000, 12 * 999 - 1, 12 * 999 - 1)


def test_no_lines(spark):
    lines = B.classify(spark.createDataFrame([], "d string, page int, line_no int, line string"))
    assert B.blocks(lines, "d").count() == 0 and chunking.chunks(B.blocks(lines, "d"), "d").count() == 0
