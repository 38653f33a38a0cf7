"""Greedy packing over tiles against a plain pass over the whole run."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import chunking


def _plain(lengths, most):
    out, group, used = [], -1, 0
    for n in lengths:
        if group < 0 or used + n > most:
            group, used = group + 1, 0
        used += n
        out.append(group)
    return out


@pytest.mark.parametrize("tile", [1, 2, 5, 64, 4096])
def test_tiles_of_any_size_give_the_same_groups(spark, tile):
    draw, rows, want = random.Random(tile), [], {}
    for k in range(60):
        most = draw.choice([0, 1, 10, 50, 1000])
        lengths = [draw.choice([0, 0, 1, 3, 10, 11, 49, 60, 2000]) for _ in range(draw.randrange(1, 70))]
        orders = sorted(draw.sample(range(-20, 300), len(lengths)))  # gaps, and tiles without rows
        want |= {(f"d{k % 7}", k, o): g for o, g in zip(orders, _plain(lengths, most), strict=True)}
        rows += [(f"d{k % 7}", k, o, n, most) for o, n in zip(orders, lengths, strict=True)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, part int, o int, n int, most int")
    got = chunking.pack(df, ["doc", "part"], "o", F.col("n"), F.col("most"), tile).collect()
    assert len(got) == len(rows)
    assert {(r.doc, r.part, r.o): r.group for r in got} == want


def test_one_long_run_is_many_rows(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("o"), (F.xxhash64("id") % 40 + 40).alias("n"))
    got = chunking.pack(df, ["doc"], "o", F.col("n"), F.lit(1000))
    lengths = [r.n for r in df.orderBy("o").collect()]
    assert [r.group for r in got.orderBy("o").select("group").collect()] == _plain(lengths, 1000)
    widest = df.groupBy(F.floor(F.col("o") / chunking.TILE)).count().agg(F.max("count")).first()[0]
    assert widest == chunking.TILE and chunking.pack(df.limit(0), ["doc"], "o", F.col("n"), F.lit(9)).count() == 0
