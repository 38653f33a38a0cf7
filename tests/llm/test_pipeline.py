"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest

from tests.llm.test_joins import classes, cut_plain
from tests.llm.test_text import plain_quality

SYLLABLES = ["ri", "sto", "wal", "un", "gre", "sev", "la", "qui", "mo", "ne", "ta", "fle"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(90)
    rows, toxic = [], []
    for k in range(60):
        own = prose(draw.randint(60, 120))
        if k % 6 == 0:
            for _ in range(6):
                own[draw.randrange(len(own))] = draw.choice(["vilewretch", "scumbag", "rottenest"])
        if k % 7 == 3:
            own = own[:20] + passage + own[20:]
        if k % 11 == 5:
            own = ["again", "and"] * 60
        rows.append((k, " ".join(own)))
        toxic.append((k, int(k % 6 == 0)))
    for k in (1, 2, 4):
        rows.append((100 + k, rows[k][1]))
        near = rows[k][1].split()
        near[10] = "changed"
        rows.append((200 + k, " ".join(near)))
    rows += [(300, None), (301, ""), (302, "too short")]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(k, t, "en", "src", len(t) if t is not None else None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, corpus):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(stage(spark, steps[-1], corpus), name))
    rows = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    assert all(s.columns == columns for s in steps[:-1])
    assert set(rows[0]) - set(rows[1]) == {k for k in rows[0] if k < 60 and k % 6 == 0}
    assert set(rows[2]) == {k for k, t in rows[1].items() if not plain_quality(t)[-1]}
    given = sorted(rows[2].items())
    graded, _ = classes(given)
    assert set(rows[3]) == {least for _, _, least in graded}
    kept = sorted(rows[3].items())
    cut = cut_plain([t.encode() for _, t in kept], 400)
    assert {k: len(rows[4][k].encode()) for k, _ in kept} == {k: n - gone for (k, _), (n, gone, _, _) in zip(kept, cut, strict=True)}
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())
    packed = steps[5].toPandas()
    assert set(packed.doc_id) == set(rows[4]) and packed.groupby("sequence_id").length.sum().max() <= 4096
    assert corpus_pipeline.run(spark, corpus).count() == len(packed)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0, name
