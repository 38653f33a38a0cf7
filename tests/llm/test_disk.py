"""What steps leave on disk and what they shuffle."""

import os
import random
import time

from pyspark.sql import functions as F

from docmill.llm import suffixdedup
from docmill.llm.shared import written
from tests.llm.test_joins import cut_plain


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    rows = spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 999).alias("k")).count()
    before, own = shuffle_files(spark), spark.conf.get(CLEANUP)
    stored = written(rows, "disk")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP) == own and stored.count() == rows.count() == 999


def shuffled(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = context._jvm
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_without_repeats_are_not_shuffled(spark):
    draw = random.Random(4)
    own = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz \n") for _ in range(n))
    passage, twice = own(450), own(500)
    texts = [own(20_000) for _ in range(150)]
    texts[3] = texts[3][:900] + passage + texts[3][900:]
    texts[40] = passage + texts[40]
    texts[77] = twice + texts[77] + twice
    texts += [texts[5], texts[77], own(399), "", None]
    docs = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    docs.count()
    before = shuffled(spark)
    got = suffixdedup.removal_digests(docs).collect()
    n = sum(v for k, v in shuffled(spark).items() if k not in before)
    want = cut_plain([(t or "").encode() for t in texts], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert sum(r.repeats_elsewhere for r in got) == 6  # 3, 40, 5 and its copy, 77 and its copy
    assert n < sum(len(t or "") for t in texts)
