"""From questions and hits to messages, and from replies to cited answers, for many questions in one plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.config import DEFAULT_CODE_PATTERNS, NOT_FOUND, CodePattern, RetrievalConfig
from docmill.functions import answers
from docmill.functions.codes import extract
from docmill.functions.text import strip
from docmill.operators import lifecycle, prompts
from docmill.operators.retrieval import hybrid, lookup
from docmill.session import stored

#: What a model is told ahead of a question and its passages.
SYSTEM_MESSAGE = f"""Use nothing but the passages below to answer the question.
Write procedures as numbered steps, name the identifiers that the question asks about, and leave out sources: they are added later.
If the passages hold no answer, write only: {NOT_FOUND}"""
#: The same for replies as JSON.
STRUCTURED_MESSAGE = """Use nothing but the passages below to answer the question.
Reply with one JSON object alone: {"found": true, "answer": "", "steps": [], "used": []}
steps holds a procedure in order, answer anything else, used the ids of the passages that you relied on; found is false if the passages hold no answer."""

_CITATION = ("chunk_id", "source_path", "page", "section")


def prepare(questions: DataFrame, hits: DataFrame, chunks: DataFrame, resolved: DataFrame | None = None, system: str = SYSTEM_MESSAGE, *beside: str) -> DataFrame:
    """(query_id, question, found, retrieved, resolved, messages, the questions' columns beside) of every question.

    ``hits`` has query_id, rank and chunk_id, and source_path where it is part of a chunk's key; ``chunks`` chunk_id, source_path, page, section, kind, text and
    codes (array of values); ``resolved`` query_id, position, value of identifiers that the index holds.
    ``retrieved`` lists the hits that have a chunk, in order of rank. A question without any is not found
    and gets no messages. Repeated hits stay; a null rank comes first.
    """
    passage = prompts.passage(F.col("chunk_id"), F.col("section"), F.col("codes"), F.col("kind"), F.col("text"))
    key = ["chunk_id", *(c for c in ("source_path",) if c in hits.columns)]
    rows = hits.select("query_id", "rank", *key).join(chunks.select(*_CITATION, "kind", "text", "codes"), key)
    own = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *_CITATION, "codes", passage.alias("passage")))).alias("retrieved"))
    made = questions.select("query_id", "question", *beside).join(own, "query_id", "left")
    none = F.array().cast("array<string>")
    if resolved is None:
        made = made.withColumn("resolved", none)
    else:
        named = resolved.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "value")))["value"].alias("resolved"))
        made = made.join(named, "query_id", "left").withColumn("resolved", F.coalesce("resolved", none))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.array(message("system", F.lit(system)), message("user", prompts.user_prompt(F.col("question"), F.col("retrieved")["passage"])))
    found = F.col("retrieved").isNotNull()
    return made.select("query_id", "question", found.alias("found"), "retrieved", "resolved", F.when(found, asked).alias("messages"), *beside)


def ask(
    spark: SparkSession, path: str, questions: DataFrame, embed: Callable[[DataFrame], DataFrame], config: RetrievalConfig | None = None, rules: Sequence[CodePattern] = DEFAULT_CODE_PATTERNS, model: str = "", system: str = SYSTEM_MESSAGE
) -> tuple[DataFrame, DataFrame]:
    """(prepared, hits) of bare questions (query_id, question) to the index at a path: their identifiers are looked up
    in its postings, their vectors in its blocks, both kinds of hits are merged, and messages are made.

    ``embed`` turns (query_id, embedding_text) into (query_id, v). Hits are (query_id, chunk_id, source_path, score,
    match_type, rank); beside ``prepare``'s columns, prepared has matched, how many hits of each type there are, null without any.
    All of it reads one version of the index. A question that is null or empty has no identifiers;
    a model that is not the index's own gives a warning. Chunks without a page, section or kind have none.

    An equal question is asked once: ``embed`` is given a checksum of the question as its query_id, and what it found goes to all
    queries that have it. The hits are stored once, and only chunks that are hits leave the place where they lie.
    """
    config = config or RetrievalConfig()
    version = lifecycle.latest(spark, path)
    now = lifecycle.load(spark, path, version)
    if now is None:
        raise lifecycle.NoIndex(path)
    if said := lifecycle.model_warning(spark, path, model):
        warnings.warn(said, stacklevel=2)
    who = questions.select("query_id", "question", F.coalesce(F.sha2("question", 256), F.lit("")).alias("asked"))
    once = stored(who.select(F.col("asked").alias("query_id"), "question").distinct(), "asked")
    named = once.select("query_id", F.posexplode(extract(F.col("question"), rules)["value"]).alias("position", "value")).withColumn("bucket", lifecycle.bucket(F.col("value")))
    near, _ = lifecycle.search(spark, path, embed(once.select("query_id", F.coalesce("question", F.lit("")).alias("embedding_text"))), config, version)
    by_code = lookup(named, now["postings"], "source_path")
    hits = stored(hybrid(near, by_code, config, None, "source_path"), "hits")
    chunks = lifecycle.chunks_of(spark, path, hits.select("source_path", "chunk_id").distinct(), version)
    defaults = {"page": "int", "section": "string", "kind": "string", "codes": "array<struct<kind:string,value:string,raw:string>>"}
    for name, kind in defaults.items():
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    chunks = chunks.withColumn("codes", F.col("codes")["value"])
    resolved = named.join(now["postings"].select("bucket", "value"), ["bucket", "value"], "left_semi")
    kinds = hits.groupBy("query_id").agg(F.struct(*(F.count_if(F.col("match_type") == k).alias(k) for k in ("code", "semantic", "hybrid"))).alias("matched"))
    made = prepare(once.join(kinds, "query_id", "left"), hits, chunks, resolved, system, "matched")
    own = lambda rows: rows.withColumnRenamed("query_id", "asked")
    prepared = who.join(own(made).drop("question"), "asked")
    return prepared.select("query_id", "question", "found", "retrieved", "resolved", "messages", "matched"), own(hits).join(who.select("query_id", "asked"), "asked").select("query_id", *hits.columns[1:])


def citations(ids: Column, retrieved: Column) -> Column:
    """array<struct<chunk_id,source_path,page,section>> of the ids that were retrieved, in their order."""
    place = lambda i: F.try_element_at(F.filter(retrieved, lambda r: r["chunk_id"] == i), F.lit(1))
    known = F.filter(F.transform(ids, place), lambda r: r.isNotNull())
    return F.transform(known, lambda r: F.struct(*(r[c].alias(c) for c in _CITATION)))


def assemble(prepared: DataFrame, replies: DataFrame, structured: bool = False) -> DataFrame:
    """(query_id, found, text, citations, referenced) of every prepared question and its reply (query_id,
    reply; one row a question, a missing or null reply is empty).

    Not found are questions without hits and replies that say so; their text is the not-found sentence.
    With ``structured`` a JSON reply with content is an answer whatever its flag says, one without is not
    found, and a reply that holds no JSON counts as prose. Without cited ids the first few hits stand.
    """
    rows = prepared.join(replies.select("query_id", "reply"), "query_id", "left").withColumn("reply", F.coalesce("reply", F.lit("")))
    ids = F.col("retrieved")["chunk_id"]
    said = strip(F.col("reply"))
    rows = rows.withColumn("said", said).withColumn("ids", ids)
    rows = rows.withColumn("p", answers.parse_structured(F.col("reply"), F.col("ids")) if structured else F.lit(None).cast("struct<found:boolean,answer:string,steps:array<string>,used:array<string>>"))
    prose = F.col("p").isNull()
    empty = F.when(prose, answers.is_not_found(F.col("said"))).otherwise((F.col("p.answer") == "") & (F.size("p.steps") == 0))
    found = F.col("found") & ~empty
    text = F.when(prose, F.col("said")).otherwise(strip(answers.render_structured(F.col("p.answer"), F.col("p.steps"))))
    cited = answers.cited_or_first(F.when(prose, F.col("said")).otherwise(""), F.col("ids"))
    cited = F.when(~prose & (F.size("p.used") > 0), F.col("p.used")).otherwise(cited)
    codes = prompts.referenced_codes(F.col("resolved"), F.col("retrieved")["codes"])
    rows = rows.withColumn("is_found", found).withColumn("cited", cited)
    return rows.select(
        "query_id", F.col("is_found").alias("found"), F.when(F.col("is_found"), text).otherwise(NOT_FOUND).alias("text"),
        F.when(F.col("is_found"), citations(F.col("cited"), F.col("retrieved"))).otherwise(F.expr("array()")).alias("citations"),
        F.when(F.col("is_found"), codes).otherwise(F.array().cast("array<string>")).alias("referenced"),
    )


def provenance(answered: DataFrame) -> DataFrame:
    """(query_id, position, source_path, page, section) of each answer's different places, where each is
    first cited."""
    rows = answered.select("query_id", F.posexplode("citations").alias("position", "c")).select("query_id", "position", "c.source_path", "c.page", "c.section")
    return rows.groupBy("query_id", "source_path", "page", "section").agg(F.min("position").alias("position")).select("query_id", "position", "source_path", "page", "section")
