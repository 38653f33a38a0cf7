"""Behaviours of the document operators on small hand-made inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docmill.config import NOT_FOUND, ChunkingConfig, RetrievalConfig
from docmill.functions import answers, codes
from docmill.functions import text as T
from docmill.operators import blocks as B
from docmill.operators import chunking, evaluate, lifecycle, prompts, retrieval

MANUAL = """PUMP STATION GUIDE
This guide covers the
small pump.

RESTART
1. Close the valve.
2) Press start.
Step 3 Wait.\fFAULTS
ALARM 204 means low pressure. See stop code 12
or part no. AB-44-19.
| Part | Code |
| --- | --- |
| Seal | PN 77-A1 |
CONTENTS . . . . . 4-11
"""


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr).first()[0]


def made_blocks(spark, text, key="d"):
    docs = spark.createDataFrame([(key, text)], "document_id string, text string")
    return B.blocks(B.classify(B.page_lines(B.split_pages(docs, "document_id"), "document_id")), "document_id")


def test_blocks(spark):
    rows = made_blocks(spark, MANUAL).orderBy("block_no").collect()
    assert [(r.kind, r.page) for r in rows] == [("heading", 1), ("paragraph", 1), ("heading", 1), ("step", 1), ("step", 1), ("step", 1), ("heading", 2), ("paragraph", 2), ("table", 2)]
    assert rows[1].text == "This guide covers the small pump."
    assert rows[8].rows == [["Part", "Code"], ["Seal", "PN 77-A1"]] and rows[8].text == "Part | Code\nSeal | PN 77-A1"


@pytest.mark.parametrize(
    ("line", "kind"),
    [("1. STOP THE UNIT", "heading"), ("DRIVE BELT 44-19", "paragraph"), ("||", "paragraph"), ("## Setup ##", "heading"), ("a|b", "table"), ("  12) go on", "step"), ("INTRO - - - - 1-1", "navigation"), (" \t", "blank"), ("ÉTAT", "heading")],
)
def test_line_kinds(spark, line, kind):
    assert one(spark, T.line_kind(F.col("x")), x=line) == kind


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\x0bc\x1cd e\x85f\n\n", "\n"])
def test_lines_are_pythons(spark, text):
    assert one(spark, T.lines(F.col("x")), x=text) == text.splitlines()


def test_chunks(spark):
    got = chunking.chunks(made_blocks(spark, MANUAL), "document_id").orderBy("ordinal").collect()
    assert [r.kind for r in got] == ["paragraph", "step", "paragraph", "table"]
    assert got[1].text == "1. Close the valve.\n2) Press start.\nStep 3 Wait." and got[1].section == "RESTART"
    assert {c.value for c in got[2].codes} >= {"AL-204", "SC-12", "PN-AB-44-19"}
    assert got[0].chunk_id == hashlib.sha1(f"d|0|1|{got[0].text}".encode()).hexdigest()[:16]
    assert got[3].rows and got[0].rows is None


def test_a_heading_alone_makes_no_chunk(spark):
    assert chunking.chunks(made_blocks(spark, "ONLY A HEADING"), "document_id").count() == 0


def test_greedy_packing(spark):
    got = spark.createDataFrame([([30, 30, 30, 60, 5, 5], 50), ([], 5)], "n array<int>, b int").select(chunking.greedy_groups("n", "b")).collect()
    assert [r[0] for r in got] == [[0, 1, 2, 3, 4, 4], []]


def test_step_budget(spark):
    text = "\n".join(f"{k}. {'x' * 20}" for k in range(1, 6))
    got = chunking.chunks(made_blocks(spark, text), "document_id", ChunkingConfig(step_max_chars=50)).collect()
    assert len(got) == 3


@pytest.mark.parametrize(
    ("text", "values"),
    [("alarm 20456", ["AL-2045"]), ("shelf 023", []), ("DTC-E30", ["DTC-E30", "E-30"]), ("part PN-44-19A", ["PN-PN-44-19A"]), ("AL204, ALARM:204 and F 77", ["AL-204", "F-77"]), (None, []), ("stop code 5a", ["SC-5"])],
)
def test_codes(spark, text, values):
    row = spark.createDataFrame([(text,)], "x string").select(codes.extract(F.col("x"))["value"].alias("v")).first()
    assert row.v == values


def test_hybrid_merge(spark):
    sem = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9)], "query_id long, chunk_id long, score double")
    code = spark.createDataFrame([(1, 10), (1, 12), (1, 99)], "query_id long, chunk_id long")
    chunks = spark.createDataFrame([(10,), (11,), (12,)], "chunk_id long")
    got = retrieval.hybrid(sem, code, RetrievalConfig(), chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.match_type) for r in got] == [(10, 1.5, "hybrid"), (12, 1.0, "code"), (11, 0.9, "semantic")]


def test_semantic_leaves_out_nulls_and_keeps_ties_in_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None])], "id long, v array<double>")
    got = retrieval.semantic(v.where("id = 1"), v, RetrievalConfig(top_k=6, min_score=-1.0), exclude_self=True).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(2, 1.0), (3, 1.0), (5, 0.0)]
    # ids of queries and chunks are different name spaces unless one says otherwise, and may be of any type
    got = retrieval.semantic(v.where("id = 1"), v.withColumn("id", F.concat(F.lit("c"), "id")), RetrievalConfig(top_k=6, min_score=-1.0)).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "c1"), (1, "c2"), (1, "c3"), (1, "c5")]


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [(True, True, [1], [1, 2], ["A"], ["A"]), (True, False, [9], [1], [], []), (False, False, [], [], [], [])],
        "should_find boolean, found boolean, expected_pages array<int>, pages array<int>, expected_codes array<string>, codes array<string>",
    )
    r = evaluate.rates(evaluate.outcomes(cases)).first()
    assert (r.found_accuracy, r.page_hit_rate, r.code_resolution_rate, r.not_found_accuracy) == (2 / 3, 0.5, 1.0, 1.0)
    assert evaluate.rates(evaluate.outcomes(cases.limit(0))).first().page_hit_rate == 1.0


@pytest.mark.parametrize(("reply", "expected"), [(NOT_FOUND, True), (f"Sadly, {NOT_FOUND} [abc123]", True), ("", False), (f"{NOT_FOUND} But here is a long and full answer to it all.", False)])
def test_not_found(spark, reply, expected):
    assert one(spark, answers.is_not_found(F.col("x")), x=reply) is expected


def test_citations(spark):
    offered = F.array(F.lit("aaaaaa"), F.lit("bbbbbb"), F.lit("cccccc"), F.lit("dddddd"))
    assert one(spark, answers.cited_or_first(F.col("x"), offered), x="see [cccccc, ffffff] and aaaaaa") == ["cccccc", "aaaaaa"]
    assert one(spark, answers.cited_or_first(F.col("x"), offered), x="none") == ["aaaaaa", "bbbbbb", "cccccc"]
    assert one(spark, answers.clean_answer(F.col("x")), x=f"Do it [aaaaaa].\n{NOT_FOUND}\n") == "Do it."


def test_structured(spark):
    offered = F.array(F.lit("aaaaaa"))
    got = one(spark, answers.parse_structured(F.col("x"), offered), x='```json\n{"answer": "", "steps": ["1. a", "", "- b"], "used": ["[aaaaaa]", "zz"]}\n```')
    assert (got.found, got.steps, got.used) == (True, ["a", "b"], ["aaaaaa"])
    assert one(spark, answers.parse_structured(F.col("x"), offered), x="{broken") is None
    assert one(spark, answers.clean_captions(F.col("x")), x="- a\nNONE\n\n1. b") == ["a", "b"]


def test_prompt_has_no_paths(spark):
    got = one(spark, prompts.passage(F.lit("id1"), F.lit("S"), F.array(F.lit("AL-1")), F.lit("table"), F.lit("t")), x=1)
    assert got == "[id1] (section: S)\nIdentifiers: AL-1\n(table)\nt"


def test_running_headers(spark):
    docs = spark.createDataFrame([("d", p, f"Page {p} of 9\nbody {'abcdefghi'[p - 1]}\nend {'xyzuvwqrs'[p - 1]}") for p in range(1, 10)], "source string, page int, text string")
    lines = B.page_lines(docs, "source")
    assert [r.form for r in B.running_forms(lines, "source").collect()] == ["Page # of #"]
    assert B.drop_running(lines, "source").count() == 18


def test_lifecycle(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    files = lambda rows: spark.createDataFrame([(p, c.encode()) for p, c in rows], "source_path string, content binary").withColumn("content_hash", chunking.content_hash(F.col("content")))
    parse = lambda f: f.select("source_path", F.concat("source_path", F.lit("#0")).alias("chunk_id"), F.col("content").cast("string").alias("text"))
    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.length("text").cast("double")).alias("v"))
    lifecycle.update(spark, path, files([("x/a.txt", "one"), ("x/b.txt", "two")]), parse, embed, "m1", "T0")
    todo = lifecycle.update(spark, path, files([("x/a.txt", "ONE!"), ("x/b.txt", "two"), ("x/c.txt", "three")]), parse, embed, "m1", "T1")
    assert {r.source_path: r.action for r in todo.collect()} == {"x/a.txt": "refreshed", "x/b.txt": "skipped", "x/c.txt": "added"}
    now = lifecycle.load(spark, path)
    assert sorted(r.text for r in now["chunks"].collect()) == ["ONE!", "three", "two"]
    assert (now["meta"].first().created_at, now["meta"].first().updated_at) == ("T0", "T1")
    with pytest.raises(lifecycle.ModelMismatch):
        lifecycle.update(spark, path, files([("x/d.txt", "d")]), parse, embed, "m2", "T2")
    assert [r.source_path for r in lifecycle.remove(spark, path, ["a.txt"]).collect()] == ["x/a.txt"]
    assert lifecycle.load(spark, path)["chunks"].count() == 2


def test_removal_names_all(spark):
    paths = ["x/a.txt", "y/a.txt", "dir/b.txt", "z/b.txt", "q/ab.txt", "deep/er/c.txt", *(f"m/{k}.txt" for k in range(12_000))]
    registry = spark.createDataFrame([(p,) for p in paths], "source_path string")
    gone = lambda names: {r[0] for r in lifecycle.removal(registry, spark.createDataFrame([(n,) for n in names], "target string")).collect()}
    assert gone(["dir/a.txt"]) == {"x/a.txt", "y/a.txt"}
    assert gone(["dir/b.txt"]) == {"dir/b.txt"}
    assert gone(["b.txt"]) == {"dir/b.txt", "z/b.txt", "q/ab.txt"} and gone(["er/c.txt"]) == {"deep/er/c.txt"}
    assert gone([f"{k}.txt" for k in range(12_000)]) >= {f"m/{k}.txt" for k in range(12_000)}
    assert gone([]) == set() and gone([None, "none"]) == set()


def test_stream_updates_the_index(spark, tmp_path):
    from docmill.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MD").write_text("hello")
    parse = lambda f: f.select("source_path", F.lit("c").alias("chunk_id"), F.col("content").cast("string").alias("text"))
    embed = lambda c: c.select("chunk_id", "source_path", F.array(F.lit(1.0)).alias("v"))
    ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ix", f"file://{tmp_path}/cp", parse, embed).awaitTermination(60)
    assert lifecycle.load(spark, f"file://{tmp_path}/ix")["chunks"].count() == 1
