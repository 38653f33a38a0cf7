"""Registered queries over whole workflows: chunking, the life cycle of an index, questions and answers.

Each reads its whole tables. Where a workflow needs files, a document of the table is a file; where it
needs questions, a conversation's first turn asks and its other turns are the passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.config import DEFAULT_CODE_PATTERNS, NOT_FOUND, RetrievalConfig
from docmill.functions import answers, codes
from docmill.functions import text as T
from docmill.jobs import catalogue
from docmill.operators import answering, chunking, evaluate, lifecycle, modelcalls, retrieval
from docmill.operators import blocks as B
from docmill.session import shared_folder
from docmill.sources.documents import pages_by, route, text_pages
from docmill.sources.tables import read_table

SPACE = r"'^\s+|\s+$'"


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document, joined from its lines."""
    own = catalogue._blocks(spark, sf_dir).where("kind = 'paragraph'")
    return own.select("doc_id", "island", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


_PARAGRAPHS = f"""select doc_id, island::bigint as island, length(t)::bigint as chars, md5(t) as text_md5 from (
  select doc_id, island, regexp_replace(string_agg(s, ' ' order by line_no), {SPACE}, '', 'g') as t from {catalogue._ISLANDS} where kind = 'paragraph' group by 1, 2)"""


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.line_titles(B.classify(catalogue._document_lines(spark, sf_dir)), "doc_id")


_HEAD = "coalesce(nullif(regexp_extract(s, '^\\s*#{1,6}\\s+(.+?)\\s*#*\\s*$', 1), ''), s)"
_BLOCKS = f"""(select doc_id, island, kind, min(line_no) as place,
  case when kind = 'table' then string_agg(array_to_string(cells, ' | '), chr(10) order by line_no) filter (not rule)
    when kind = 'heading' then {_HEAD.replace("s,", "any_value(s),").replace(", s)", ", any_value(s))")}
    else regexp_replace(string_agg(s, ' ' order by line_no), {SPACE}, '', 'g') end as text
  from (select *, list_bool_and(list_transform(cells, lambda x: x = '' or regexp_matches(x, '^:?-{{2,}}:?$'))) as rule from {catalogue._ISLANDS})
  where kind not in ('blank', 'navigation') group by doc_id, island, kind having kind <> 'table' or count(*) filter (not rule) > 0)"""
_TITLES = f"""select doc_id, coalesce(min_by(text, place) filter (kind = 'heading'), doc_id::varchar) as title from {_BLOCKS} group by 1"""


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to chunks as an index would hold them: all columns but identifiers; the id covers the text."""
    made = chunking.chunks(catalogue._blocks(spark, sf_dir), "doc_id", rules=DEFAULT_CODE_PATTERNS[:1])
    return made.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id", F.length("text").cast("long").alias("chars"), F.col("page").cast("long").alias("page"), "section", "kind", F.size("rows").cast("long").alias("n_rows"))


_CHUNKS = f"""with recursive b as materialized (select *, row_number() over (partition by doc_id order by place) as n,
    last_value(case when kind = 'heading' then text end ignore nulls) over (partition by doc_id order by place rows unbounded preceding) as section,
    case kind when 'heading' then 'heading' when 'table' then 'table' when 'step' then 'steps' else 'text' end as sort from {_BLOCKS}),
g as (select *, sum(fresh) over (partition by doc_id order by place) as segment from (
  select *, case when sort in ('steps', 'text') and lag(sort) over (partition by doc_id order by place) = sort then 0 else 1 end as fresh from b)),
r as materialized (select *, row_number() over (partition by doc_id, segment order by place) as k, case sort when 'steps' then 2400 else 1200 end as most, length(text) as len from g where sort <> 'heading'),
p as (select doc_id, segment, k, 0 as part, len as used from r where k = 1
  union all select r.doc_id, r.segment, r.k, case when p.used + r.len > r.most then p.part + 1 else p.part end, case when p.used + r.len > r.most then r.len else p.used + r.len end
  from p join r on r.doc_id = p.doc_id and r.segment = p.segment and r.k = p.k + 1),
c as (select r.doc_id, r.segment, p.part, min(place) as place, regexp_replace(string_agg(text, chr(10) order by place), {SPACE}, '', 'g') as text, min_by(section, place) as section,
  case when bool_or(kind = 'table') then 'table' when bool_and(kind = 'step') then 'step' else 'paragraph' end as kind
  from r join p on p.doc_id = r.doc_id and p.segment = r.segment and p.k = r.k group by 1, 2, 3),
o as (select *, row_number() over (partition by doc_id order by place) - 1 as ordinal from c where text <> '')
select doc_id, ordinal, sha1(doc_id || '|' || ordinal || '|1|' || text)[:16] as chunk_id, length(text)::bigint as chars, 1::bigint as page, section, kind,
  case when kind = 'table' then len(string_split(text, chr(10)))::bigint end as n_rows from o"""


def _marked(column: str = "text") -> Column:
    """Each document's text after identifiers of all seven kinds, made from its columns in varied spellings."""
    d = F.col("doc_id")
    head = F.concat(
        F.lit("Alm-"), d % 700, F.lit("B, SC "), d % 90, F.lit("; FLT:"), d % 300, F.lit(" err_"), d % 410, F.lit(" and DTC P"), d % 3000, F.lit(", warn "), d % 77, F.lit(" / P/N #"),
        F.substring(F.md5(d.cast("string")), 1, 4), F.lit("-"), d, F.lit(" then stopcode "), d % 7, F.lit(" xF12 "),
    )
    return F.concat(head, F.coalesce(column, F.lit("")))


def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all seven rules over every document."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), codes.extract(_marked()).alias("codes"))
    return retrieval.postings(docs).groupBy("value").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


def _rule_sql() -> str:
    made = r"""regexp_replace('Alm-' || (doc_id % 700) || 'B, SC ' || (doc_id % 90) || '; FLT:' || (doc_id % 300) || ' err_' || (doc_id % 410) || ' and DTC P' || (doc_id % 3000) || ', warn ' || (doc_id % 77) || ' / P/N #'
      || md5(doc_id::varchar)[:4] || '-' || doc_id || ' then stopcode ' || (doc_id % 7) || ' xF12 ' || coalesce(text, ''), '[^A-Za-z0-9]', '\0\0', 'g')"""
    # every sign stands twice, so that the sign before a match and the one after the last are two
    rules = {
        "AL": r"(?:ALARM|ALM|AL)[\s\-:_]*(\d{1,4}[A-Z]?)", "SC": r"(?:STOP[\s\-]{0,2}CODE|STOP|SC)[\s\-:_]*(\d{1,4})", "F": r"(?:FAULT|FLT|F)[\s\-:_]*(\d{2,4})", "E": r"(?:ERROR|ERR|E)[\s\-:_]*(\d{2,4})",
        "DTC": r"DTC[\s\-:_]*([A-Z]?\d{2,5})", "W": r"(?:WARNING|WARN|W)[\s\-:_]*(\d{2,4})", "PN": r"(?:PART\s+(?:NO(?:\.\.)?|NUMBER)|PART|P(?://)?N)[\s\-:#]*([A-Z0-9]{2,}(?:--[A-Z0-9]+)+)",
    }
    lists = [f"list_transform(regexp_extract_all(t, '(?i)(?:^|[^A-Za-z0-9]){r}', 1), lambda x: '{p}-' || replace(upper(x), '--', '-'))" for p, r in rules.items()]
    return f"select value, count(*) as chunks, min(doc_id) as first_chunk from (select distinct doc_id, unnest({' || '.join(lists)}) as value from (select doc_id, {made} as t from documents)) group by 1"


def _as_files(docs: DataFrame, old: bool) -> DataFrame:
    """Documents as files; an older state lacks those divisible by 7 and has other texts where 10 divides."""
    text = F.coalesce("text", F.lit(""))
    if old:
        docs = docs.where("doc_id % 7 <> 0")
        text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("old\n"), text)).otherwise(text)
    rows = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("source_path"), text.cast("binary").alias("content"))
    return rows.withColumn("content_hash", chunking.content_hash(F.col("content")))


def _parse(files: DataFrame) -> DataFrame:
    """A chunk a line that isn't blank."""
    lines = B.page_lines(files.select("source_path", F.lit(1).alias("page"), F.col("content").cast("string").alias("text")), "source_path")
    lines = lines.withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    return lines.select("source_path", chunking.chunk_id(F.col("source_path"), F.col("line_no"), F.lit(1), F.col("s")).alias("chunk_id"), F.col("s").alias("text"))


def _embed(*features: Column):
    return lambda chunks: chunks.select("chunk_id", "source_path", F.array(*features).cast("array<double>").alias("v"))


def _updated(spark: SparkSession, sf_dir: str) -> str:
    """An index of the older state, brought up to date."""
    docs = read_table(spark, sf_dir, "documents")
    path = shared_folder(spark, "index")
    embed = _embed(F.length("text"))
    lifecycle.update(spark, path, _as_files(docs, True), _parse, embed, "lengths", "T0")
    lifecycle.update(spark, path, _as_files(docs, False), _parse, embed, "lengths", "T1")
    return path


def _held(index: dict[str, DataFrame]) -> DataFrame:
    """(source_path, chars, total) of the chunks that have a vector; only their lengths are shuffled."""
    sizes = index["chunks"].select("source_path", "chunk_id", F.length("text").alias("chars"))
    firsts = index["vectors"].select("source_path", "chunk_id", F.col("v")[0].alias("first"))
    return sizes.join(firsts, ["source_path", "chunk_id"]).groupBy("source_path").agg(F.sum("chars").alias("chars"), F.sum("first").cast("long").alias("total"))


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after an index of an older state was updated, with each document's stored text."""
    path = _updated(spark, sf_dir)
    now = lifecycle.load(spark, path)
    stored = _held(now)
    done = lifecycle.last_actions(spark, path).select("source_path", "action")
    rows = now["registry"].join(done, "source_path").join(stored, "source_path", "left")
    zero = F.lit(0).cast("long")
    return rows.select("source_path", "content_hash", "document_id", "chunk_count", "action", F.coalesce("chars", zero).alias("chars"), F.coalesce("total", zero).alias("total"))


def index_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of an index that was written as one JSON document and read into another index, with what that
    one holds of each document."""
    text, copy = shared_folder(spark, "exchange"), shared_folder(spark, "index")
    lifecycle.export_json(spark, _updated(spark, sf_dir), text)
    lifecycle.import_json(spark, text, copy)
    now = lifecycle.load(spark, copy)
    stored = _held(now)
    zero = F.lit(0).cast("long")
    meta = now["meta"].select("embedding_model", "created_at", "updated_at").first()
    rows = now["registry"].join(stored, "source_path", "left").select("source_path", "content_hash", "document_id", "title", "chunk_count", F.coalesce("chars", zero).alias("chars"), F.coalesce("total", zero).alias("total"))
    return rows.withColumn("said", F.lit(f"{meta['embedding_model']} {meta['created_at']} {meta['updated_at']}"))


_FILES = f"""(select d.source || '/' || d.doc_id || '.txt' as source_path, d.doc_id, sha256(coalesce(d.text, ''))[:16] as content_hash, coalesce(n, 0) as n, coalesce(chars, 0) as chars
  from documents d left join (select doc_id, count(*) as n, sum(length(s))::bigint as chars from {catalogue._LINES} where s <> '' group by 1) l on l.doc_id = d.doc_id)"""


def index_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the index after paths were removed by exact path, base name and path end; a row a source."""
    path = _updated(spark, sf_dir)
    source = read_table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    lifecycle.remove(spark, path, [f"{source}/11.txt", "elsewhere/12.txt", "3.txt", "none.txt"], "T2")
    now = lifecycle.load(spark, path)
    left = now["registry"].select(F.regexp_extract("source_path", "^(.*)/", 1).alias("source"), "chunk_count")
    meta = now["meta"].select("updated_at", F.col("total_documents").alias("total")).first()
    return left.groupBy("source").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks")).select("*", F.lit(meta["updated_at"]).alias("updated_at"), F.lit(meta["total"]).alias("total"))


_REMOVED = f"""with t as (select unnest([(select min(source) from documents) || '/11.txt', 'elsewhere/12.txt', '3.txt', 'none.txt']) as target),
loose as (select target from t where target not in (select source_path from {_FILES})),
gone as (select source_path from {_FILES} where source_path in (select target from t)
  union select source_path from {_FILES} f join loose on string_split(source_path, '/')[-1] = string_split(target, '/')[-1] or suffix(source_path, target)),
l as (select * from {_FILES} where source_path not in (select source_path from gone))
select regexp_extract(source_path, '^(.*)/', 1) as source, count(*) as documents, sum(n)::bigint as chunks, 'T2' as updated_at, (select count(*) from l) as total from l group by 1"""


def index_reembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another model made from the stored chunks, summed up by source."""
    path = _updated(spark, sf_dir)
    lifecycle.reembed(spark, path, _embed(F.length("text"), F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))), "letters", "T3")
    now = lifecycle.load(spark, path)
    meta = now["meta"].first()
    rows = now["vectors"].groupBy(F.regexp_extract("source_path", "^(.*)/", 1).alias("source"))
    sums = rows.agg(F.count("*").alias("vectors"), F.sum(F.col("v")[0]).cast("long").alias("first"), F.sum(F.col("v")[1]).cast("long").alias("second"))
    return sums.select("*", F.lit(meta["embedding_model"]).alias("model"), F.lit(meta["vector_dim"]).cast("long").alias("dim"), F.lit(meta["created_at"]).alias("created_at"))


_REEMBED = f"""select source, count(*) as vectors, sum(length(s))::bigint as first, sum(length(s) - length(replace(s, 'e', '')))::bigint as second, 'letters' as model, 2::bigint as dim, 'T0' as created_at
from {catalogue._LINES} where s <> '' group by 1"""


FEATURES = 16
LOOKUP = RetrievalConfig(top_k=6, min_score=0.75)


def _digest_vector(text: Column) -> Column:
    """A vector of a text's checksum: equal texts are equal, others as good as random."""
    digits = F.split(F.substring(F.md5(text), 1, FEATURES), "")  # an argument, so that the checksum is made once
    return F.transform(digits, lambda d: F.call_function("instr", F.lit("0123456789abcdef"), d).cast("double") - 8.5)


def _alarm_parse(files: DataFrame) -> DataFrame:
    """A chunk a line that isn't blank, with its alarms; every third line stands in a section."""
    lines = B.page_lines(files.select("source_path", F.lit(1).alias("page"), F.col("content").cast("string").alias("text")), "source_path")
    lines = lines.withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    section = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("Part "), F.col("line_no") % 4))
    name = chunking.chunk_id(F.col("source_path"), F.col("line_no"), F.lit(1), F.col("s"))
    return lines.select("source_path", name.alias("chunk_id"), F.col("s").alias("text"), "page", section.alias("section"), F.lit("paragraph").alias("kind"), codes.extract(F.col("s"), DEFAULT_CODE_PATTERNS[:1]).alias("codes"))


def _alarm_files(docs: DataFrame, old: bool) -> DataFrame:
    headed = docs.withColumn("text", F.concat(F.lit("ALARM "), F.col("doc_id") % 500, F.lit("\n"), F.coalesce("text", F.lit(""))))
    return _as_files(headed, old)


def _alarm_index(spark: SparkSession, sf_dir: str) -> str:
    """An index of an older state, brought up to date, without the documents named 12.txt and 13.txt."""
    docs = read_table(spark, sf_dir, "documents")
    path = shared_folder(spark, "index")
    embed = lambda chunks: chunks.select("chunk_id", "source_path", _digest_vector(F.col("embedding_text")).alias("v"))
    lifecycle.update(spark, path, _alarm_files(docs, True), _alarm_parse, embed, "digests", "T0")
    lifecycle.update(spark, path, _alarm_files(docs, False), _alarm_parse, embed, "digests", "T1")
    lifecycle.remove(spark, path, ["x/12.txt", "x/13.txt"], "T2")
    return path


def _alarm_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document divisible by 50 asks with its own line of identifiers."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id % 50 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("what is alarm "), F.col("doc_id") % 500, F.lit(" or alarm 9999 in "), "source", F.lit("?")).alias("question"))


def _embed_questions(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", _digest_vector(F.col("embedding_text")).alias("v"))


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest chunks of the index to each question."""
    path = _alarm_index(spark, sf_dir)
    asked = _embed_questions(_alarm_questions(spark, sf_dir).withColumnRenamed("question", "embedding_text"))
    hits, _ = lifecycle.search(spark, path, asked, RetrievalConfig(top_k=6, min_score=-1.0))
    return hits.select("query_id", "source_path", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def index_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare questions to the index: what was found, what kind of hits, resolved identifiers, and the message."""
    path = _alarm_index(spark, sf_dir)
    made, _ = answering.ask(spark, path, _alarm_questions(spark, sf_dir), _embed_questions, LOOKUP, DEFAULT_CODE_PATTERNS[:1], "digests")
    return made.select("query_id", "found", F.coalesce(F.size("retrieved"), F.lit(0)).cast("long").alias("passages"), "matched.*", F.array_join("resolved", ",").alias("resolved"), F.md5(F.col("messages")[1]["content"]).alias("asked_md5"))


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's stored postings after an update and a removal, by identifier."""
    now = lifecycle.load(spark, _alarm_index(spark, sf_dir))
    return now["postings"].groupBy("value").agg(F.count("*").alias("chunks"), F.min("source_path").alias("first_path"), F.min("chunk_id").alias("first_chunk"))


_VECTOR = "[instr('0123456789abcdef', md5({t})[i]) - 8.5 for i in range(1, 17)]::double[]"
_ALARM_LINES = rf"""a as materialized (select *, sha1(source_path || '|' || line_no || '|1|' || s)[:16] as chunk_id, case when line_no % 3 = 0 then 'Part ' || (line_no % 4) end as section,
    list_distinct(list_transform(regexp_extract_all(regexp_replace(s, '[^A-Za-z0-9]', '\0\0', 'g'), '(?i)(?:^|[^A-Za-z0-9])(?:ALARM|ALM|AL)[\s\-:_]*(\d{{1,4}}[A-Z]?)', 1), lambda x: 'AL-' || upper(x))) as codes
  from (select source || '/' || doc_id || '.txt' as source_path, line_no, s from {{lines}} where s <> '' and doc_id not in (12, 13))),
v as materialized (select *, {_VECTOR.format(t="coalesce(section || chr(10), '') || s")} as v from a),
q as materialized (select query_id, question, {_VECTOR.format(t="question")} as v from (select doc_id as query_id, 'what is alarm ' || (doc_id % 500) || ' or alarm 9999 in ' || source || '?' as question from documents where doc_id % 50 = 0)),
m as materialized (select query_id, source_path, chunk_id, score from (select query_id, source_path, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id, source_path) as r
  from (select query_id, source_path, chunk_id, list_cosine_similarity(q.v, v.v) as score from q, v)) where r <= 6)""".replace(
    "{lines}", catalogue._LINES.replace("coalesce(text, '')", "'ALARM ' || (doc_id % 500) || chr(10) || coalesce(text, '')")
)
_INDEX_SEARCH = f"""with {_ALARM_LINES}
select query_id, source_path, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id, source_path) as rank, round(score, 6) as score from m"""
_INDEX_POSTINGS = f"with {_ALARM_LINES} select value, count(*) as chunks, min(source_path) as first_path, min(chunk_id) as first_chunk from (select source_path, chunk_id, unnest(codes) as value from a) group by 1"
_INDEX_ASK = f"""with {_ALARM_LINES},
w as (select query_id, unnest(['AL-' || (query_id % 500), 'AL-9999']) as value, unnest([0, 1]) as position from q),
p as materialized (select source_path, chunk_id, unnest(codes) as value from a),
k as (select distinct query_id, source_path, chunk_id, true as by_code from w join p using (value)),
h as materialized (select *, row_number() over (partition by query_id order by score desc, chunk_id, source_path) as rank from (
  select query_id, source_path, chunk_id, coalesce(score, 0) + case when by_code then 1 else 0 end as score, case when by_code is null then 'semantic' when score is null then 'code' else 'hybrid' end as kind
  from (select * from m where score >= 0.75) full join k using (query_id, source_path, chunk_id))),
t as (select query_id, count(*) as passages, count(*) filter (kind = 'code') as code, count(*) filter (kind = 'semantic') as semantic, count(*) filter (kind = 'hybrid') as hybrid,
  string_agg(chr(10) || chr(10) || '[' || chunk_id || ']' || case when section <> '' then ' (section: ' || section || ')' else '' end || case when len(codes) > 0 then chr(10) || 'Identifiers: ' || array_to_string(codes, ', ') else '' end || chr(10) || s, '' order by rank) as said
  from h join a using (source_path, chunk_id) group by 1)
select q.query_id, passages is not null as found, coalesce(passages, 0) as passages, code, semantic, hybrid,
  coalesce((select string_agg(value, ',' order by position) from w where w.query_id = q.query_id and value in (select value from p)), '') as resolved,
  md5('Question: ' || question || chr(10) || chr(10) || 'Context passages:' || said) as asked_md5 from q left join t on t.query_id = q.query_id"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    name = F.substring(F.md5(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))), 1, 16)
    codes_ = F.array(F.concat(F.lit("AL-"), F.col("turn")), F.concat(F.lit("SC-"), F.col("conv_id") % 9))
    rows = turns.withColumn("rank", rank).withColumn("chunk_id", name).withColumn("codes", codes_)
    chunks = rows.where("rank > 1").select("chunk_id", F.concat(F.lit("conv/"), F.col("conv_id") % 50).alias("source_path"), (F.col("turn") % 3).alias("page"), F.col("role").alias("section"), F.lit("paragraph").alias("kind"), "text", "codes")
    resolved = rows.where("rank = 1 and conv_id % 5 = 0").select(F.col("conv_id").alias("query_id"), F.lit(0).alias("position"), F.concat(F.lit("F-"), F.col("conv_id")).alias("value"))
    questions = rows.where("rank = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    return answering.prepare(questions, rows.where("rank > 1").select(F.col("conv_id").alias("query_id"), "rank", "chunk_id"), chunks, resolved)


def questions_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _prepared(spark, sf_dir)
    return made.select("query_id", "found", F.coalesce(F.size("retrieved"), F.lit(0)).cast("long").alias("passages"), F.array_join("resolved", ",").alias("resolved"), F.md5(F.col("messages")[1]["content"]).alias("asked_md5"), F.md5(F.col("messages")[0]["content"]).isNotNull().alias("told"))


_TURNS = """(select *, row_number() over (partition by conv_id order by turn) as rank, md5(conv_id || '-' || turn)[:16] as chunk_id, ['AL-' || turn, 'SC-' || (conv_id % 9)] as codes from conversations)"""
_ASKED = f"""(select conv_id, max(text) filter (rank = 1) as question, list(chunk_id order by rank) filter (rank > 1) as ids, list(codes order by rank) filter (rank > 1) as codes,
  'Question: ' || max(text) filter (rank = 1) || chr(10) || chr(10) || 'Context passages:' || string_agg(chr(10) || chr(10) || '[' || chunk_id || ']' || case when role <> '' then ' (section: ' || role || ')' else '' end
    || chr(10) || 'Identifiers: ' || codes[1] || ', ' || codes[2] || chr(10) || text, '' order by rank) filter (rank > 1) as asked,
  case when conv_id % 5 = 0 then ['F-' || conv_id] else [] end as resolved, max(text) filter (rank = 2) as reply from {_TURNS} group by conv_id)"""


def _reply(c: Column, offered: Column, text: Column) -> Column:
    """A reply of one of ten shapes, by number: prose with and without ids, the not-found sentence, JSON."""
    first, second = (F.coalesce(F.try_element_at(offered, F.lit(k)), F.lit("ffffffffffffffff")) for k in (1, 2))
    n = c.cast("string")
    shapes = [
        F.concat(F.lit("  "), text, F.lit(" ")),
        F.concat(F.lit(f"Sorry. {NOT_FOUND} ["), first, F.lit("]")),
        F.concat(text, F.lit(" ["), second, F.lit(", "), first, F.lit("] and "), second),
        F.concat(F.lit('```json\n{"found": true, "answer": "", "steps": ["1. open '), n, F.lit('", "- ", 7, "2) close"], "used": ["['), second, F.lit(']", "x", 3, "'), second, F.lit('"]}\n```')),
        F.concat(F.lit('{"found": false, "answer": " value '), n, F.lit(' ", "used": []}')),
        F.lit('{"found": true, "answer": 5, "steps": "none", "used": {}}'),
        F.concat(F.lit("Here: {'answer': "), first, F.lit("} done")),
        F.concat(F.lit('text {"answer": "k"} and } '), first),
        F.concat(F.lit('It says {"found": 0, "steps": ["go", "stop '), n, F.lit('"]} as asked')),
        F.concat(F.lit('{"found": null, "answer": "a"} {"answer": "'), n, F.lit('"}')),
    ]
    out = shapes[0]
    for k in range(1, len(shapes)):
        out = F.when(c % len(shapes) == k, shapes[k]).otherwise(out)
    return out


_REPLY = f"""case x % 10 when 1 then 'Sorry. {NOT_FOUND} [' || i1 || ']' when 2 then t || ' [' || i2 || ', ' || i1 || '] and ' || i2
  when 3 then '```json' || chr(10) || '{{"found": true, "answer": "", "steps": ["1. open ' || x || '", "- ", 7, "2) close"], "used": ["[' || i2 || ']", "x", 3, "' || i2 || '"]}}' || chr(10) || '```'
  when 4 then '{{"found": false, "answer": " value ' || x || ' ", "used": []}}' when 5 then '{{"found": true, "answer": 5, "steps": "none", "used": {{}}}}'
  when 6 then 'Here: {{''answer'': ' || i1 || '}} done' when 7 then 'text {{"answer": "k"}} and }} ' || i1
  when 8 then 'It says {{"found": 0, "steps": ["go", "stop ' || x || '"]}} as asked' when 9 then '{{"found": null, "answer": "a"}} {{"answer": "' || x || '"}}' else '  ' || t || ' ' end"""


def _parsed_sql(rows: str) -> str:
    """Rows (x, offered, reply, ..) with js, answer, steps and used by DuckDB's JSON functions."""
    return rf"""(select *, case when json_type(js, '$.answer') = 'VARCHAR' then trim(json_extract_string(js, '$.answer')) else '' end as answer,
  list_filter(list_transform(case when json_type(js, '$.steps') = 'ARRAY' then json_extract(js, '$.steps[*]') else [] end, lambda s: trim(regexp_replace(trim(s ->> '$'), '^\s*(?:\d+[.)]|[-*•])\s+', ''))), lambda s: s <> '') as steps,
  list_filter(list_transform(list_filter(case when json_type(js, '$.used') = 'ARRAY' then json_extract(js, '$.used[*]') else [] end, lambda u: json_type(u) = 'VARCHAR'), lambda u: trim(trim(u ->> '$'), '[]')), lambda u: list_contains(offered, u)) as used
  from (select *, case when json_valid(bare) and left(bare, 1) = '{{' then bare when inner_ <> '' and json_valid(inner_) then inner_ end as js
    from (select *, regexp_extract(bare, '(?s)\{{.*\}}') as inner_ from (select *, trim(regexp_replace(reply, '(?i)^\s*```(?:json)?\s*|\s*```\s*$', '', 'g'), ' ' || chr(10)) as bare from {rows}))))"""


def structured_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of ten shapes, parsed; every event asks, and its type and user are what was offered."""
    rows = read_table(spark, sf_dir, "events").select("event_id", F.array(F.md5("event_type"), F.md5(F.col("user_id").cast("string"))).alias("offered"), "event_type")
    rows = rows.withColumn("p", answers.parse_structured(_reply(F.col("event_id"), F.col("offered"), F.col("event_type")), F.col("offered")))
    return rows.select("event_id", F.col("p.found").alias("found"), F.col("p.answer").alias("answer"), F.array_join("p.steps", "|").alias("steps"), F.array_join("p.used", ",").alias("used"))


_EVENTS = f"(select *, {_REPLY} as reply from (select event_id as x, [md5(event_type), md5(user_id::varchar)] as offered, md5(event_type) as i1, md5(user_id::varchar) as i2, event_type as t from events))"
_STRUCTURED = f"""select x as event_id, case when js is not null then coalesce((js ->> '$.found') not in ('false', '0', ''), not list_contains(json_keys(js), 'found')) end as found,
  case when js is not null then answer end as answer, case when js is not null then array_to_string(steps, '|') end as steps, case when js is not null then array_to_string(used, ',') end as used from {_parsed_sql(_EVENTS)}"""


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _prepared(spark, sf_dir)
    turns = read_table(spark, sf_dir, "conversations")
    said = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"].alias("t"))  # a conversation's own turns
    replies = made.select("query_id", F.col("retrieved")["chunk_id"].alias("ids")).join(said, "query_id")
    text = F.coalesce(F.try_element_at("t", F.lit(2)), F.lit(""))
    replies = replies.select("query_id", _reply(F.col("query_id"), F.coalesce("ids", F.array().cast("array<string>")), text).alias("reply"))
    return answering.assemble(made, replies, structured=True)


def answers_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _answered(spark, sf_dir)
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["chunk_id"], c["source_path"], c["page"].cast("string"), c["section"])), ",")
    return got.select("query_id", "found", F.md5("text").alias("text_md5"), cited.alias("cited"), F.array_join("referenced", ",").alias("referenced"))


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's different places."""
    return answering.provenance(_answered(spark, sf_dir)).select("query_id", F.col("position").cast("long").alias("position"), "source_path", F.col("page").cast("long").alias("page"), "section")


_SAID = f"""(select *, {_REPLY} as reply from (select *, conv_id as x, coalesce(ids, []) as offered, coalesce(ids[1], 'ffffffffffffffff') as i1, coalesce(ids[2], 'ffffffffffffffff') as i2, coalesce(a.reply, '') as t from {_ASKED.replace(" as reply from", " as said from")} a))""".replace("a.reply", "a.said")
_ANSWERED = rf"""(select conv_id, resolved, codes, found, case when not found then '{NOT_FOUND}' when js is null then said_ else trim(array_to_string(case when answer <> '' then [answer] else [] end || list_transform(steps, lambda s, i: i || '. ' || s), chr(10))) end as text,
  case when not found then [] when js is not null and len(used) > 0 then used when js is null and len(named) > 0 then named else ids[:3] end as cited from (
  select *, ids is not null and case when js is null then not (core = nf or (contains(core, nf) and length(core) <= length(nf) + 30)) else answer <> '' or len(steps) > 0 end as found,
    list_filter(list_transform(list_filter(list_transform(mentioned, lambda m, i: {{'m': m, 'i': i}}), lambda z: list_position(mentioned, z.m) = z.i), lambda z: z.m), lambda m: list_contains(offered, m)) as named from (
    select *, regexp_replace(reply, {SPACE}, '', 'g') as said_, '{NOT_FOUND.lower().rstrip(".")}' as nf,
      regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '\s*\[[0-9a-f][0-9a-f,;\s]*\]', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), ' +\n', chr(10), 'g'), {SPACE}, '', 'g')), '[.!]+$', ''), {SPACE}, '', 'g') as core,
      regexp_extract_all(regexp_replace(reply, '[^0-9a-fA-F]+', '  ', 'g'), '(?:^| )([0-9a-f]{{6,32}})(?: |$)', 1) as mentioned from {_parsed_sql(_SAID)})))"""
_CITES = f"""(select conv_id, i, chunk_id, source_path, page, section from (select conv_id, unnest(cited) as chunk_id, generate_subscripts(cited, 1) as i from {_ANSWERED})
  join (select chunk_id, 'conv/' || (conv_id % 50) as source_path, turn % 3 as page, role as section from {_TURNS}) using (chunk_id))"""
_ASSEMBLED = f"""select a.conv_id as query_id, found, md5(text) as text_md5, coalesce((select string_agg(chunk_id || ':' || source_path || ':' || page || ':' || section, ',' order by i) from {_CITES} c where c.conv_id = a.conv_id), '') as cited,
  case when not found then '' when len(resolved) > 0 then array_to_string(resolved, ',') else coalesce((select string_agg(v, ',' order by k) from (select v, min(k) as k from (select unnest(flatten(a.codes)) as v, generate_subscripts(flatten(a.codes), 1) as k) group by v)), '') end as referenced
from {_ANSWERED} a"""
_SOURCES = f"select conv_id as query_id, min(i)::bigint - 1 as position, source_path, page::bigint as page, section from {_CITES} group by conv_id, source_path, page, section"

def graded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a graded case: expected pages and identifiers made from its number."""
    made = _prepared(spark, sf_dir)
    c = F.col("query_id")
    pages = F.when(c % 4 != 1, F.array((c % 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    wanted = F.when(c % 2 == 0, F.array(F.concat(F.lit("AL-"), c % 6), F.concat(F.lit("SC-"), c % 9))).otherwise(F.array().cast("array<string>"))
    cases = made.select("query_id", pages.alias("expected_pages"), wanted.alias("expected_codes"), (c % 7 != 0).alias("should_find"))
    return evaluate.graded(cases, made).select("query_id", "found_correct", "page_hit", "codes_resolved")


_GRADED = f"""select conv_id as query_id, (ids is not null) = (conv_id % 7 <> 0) as found_correct, case when conv_id % 4 <> 1 then coalesce(list_contains(pages, conv_id % 3), false) end as page_hit,
  case when conv_id % 2 = 0 then list_has_all(coalesce(flatten(codes), []) || resolved, ['AL-' || (conv_id % 6), 'SC-' || (conv_id % 9)]) end as codes_resolved
from {_ASKED} join (select conv_id, list(turn % 3) filter (rank > 1) as pages from {_TURNS} group by 1) using (conv_id)"""


def _odd_file(path: str, content: bytes) -> list[str]:
    """Stands for a parser that takes only files of its own format."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    return content[4:].decode("utf-8", "replace").split("\f")


def index_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file where some have no parser and some are broken: action, error and chunks."""
    docs = read_table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    suffix = F.when(d % 10 == 3, ".bin").when(d % 10 == 4, ".PDF").otherwise(".txt")
    head = F.when((d % 10 == 4) & (d % 20 == 4), "%PDF").otherwise("")
    rows = docs.select(F.concat("source", F.lit("/"), d, suffix).alias("source_path"), F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    files = rows.withColumn("content_hash", chunking.content_hash(F.col("content")))
    path = shared_folder(spark, "index")

    def parse(changed: DataFrame) -> DataFrame:
        pages = route(changed, [((".txt", ".md"), text_pages), ((".pdf",), pages_by(_odd_file))])
        # in one pass, as a Python parser would be run once for its pages and once for its errors; an error is a row without a line
        own = pages.select("source_path", "page", F.when(F.col("error").isNotNull(), F.lit("-")).otherwise(F.col("text")).alias("text"), "error")
        lines = B.page_lines(own, "source_path", "error").withColumn("s", T.strip(F.col("line"))).where("s <> ''")
        fine = F.col("error").isNull()
        name = chunking.chunk_id(F.col("source_path"), F.col("line_no"), F.col("page"), F.col("s"))
        return lines.select("source_path", F.when(fine, name).alias("chunk_id"), F.when(fine, F.col("s")).alias("text"), "error")

    done = lifecycle.update(spark, path, files, parse, _embed(F.length("text")), "lengths", "T0")
    registry = lifecycle.load(spark, path)["registry"].select("source_path", "chunk_count")
    return done.join(lifecycle.failures(spark, path), "source_path", "left").join(registry, "source_path", "left").select("source_path", "action", "error", "chunk_count")


_ROUTING = f"""select source || '/' || d.doc_id || case d.doc_id % 10 when 3 then '.bin' when 4 then '.PDF' else '.txt' end as source_path, case when bad is null then 'added' else 'failed' end as action, bad as error,
  case when bad is null then coalesce(n, 0) end as chunk_count
from (select *, case when doc_id % 10 = 3 then 'unsupported' when doc_id % 20 = 14 then 'ValueError: no PDF header' end as bad from documents) d
  left join (select doc_id, count(*) as n from {catalogue._LINES} where s <> '' group by 1) l on l.doc_id = d.doc_id"""


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is asked about every document, first about some: each different text is one call."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("payload"))
    store = shared_folder(spark, "calls")
    said = lambda texts: [f"{len(t)} characters" for t in texts]
    modelcalls.ask(spark, store, docs.where("doc_id % 3 = 0"), said, "lengths")
    out = modelcalls.ask(spark, store, docs, said, "lengths")
    done = modelcalls.stored(spark, store, "string").agg(F.count("*").alias("calls"))
    return out.select("doc_id", F.col("result").alias("said")).crossJoin(done)  # one row


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_blocks, document_titles, document_chunks, code_rules, index_update, index_exchange, index_remove, index_reembed, index_search, index_postings, index_ask, index_routing, model_calls, graded_cases, questions_prepared, structured_replies, answers_assembled, answer_sources,
    )
}

ORACLES = {
    "paragraph_blocks": _PARAGRAPHS,
    "document_titles": _TITLES,
    "document_chunks": _CHUNKS,
    "code_rules": _rule_sql(),
    "index_update": f"select source_path, content_hash, doc_id::varchar as document_id, n as chunk_count, case when doc_id % 7 = 0 then 'added' when doc_id % 10 = 0 then 'refreshed' else 'skipped' end as action, chars, chars as total from {_FILES}",
    "index_exchange": f"select source_path, content_hash, doc_id::varchar as document_id, doc_id::varchar as title, n as chunk_count, chars, chars as total, 'lengths T0 T1' as said from {_FILES}",
    "index_remove": _REMOVED,
    "index_reembed": _REEMBED,
    "index_search": _INDEX_SEARCH,
    "index_postings": _INDEX_POSTINGS,
    "index_ask": _INDEX_ASK,
    "index_routing": _ROUTING,
    "model_calls": "select doc_id, length(coalesce(text, '')) || ' characters' as said, (select count(distinct coalesce(text, '')) from documents) as calls from documents",
    "graded_cases": _GRADED,
    "questions_prepared": f"select conv_id as query_id, ids is not null as found, coalesce(len(ids), 0)::bigint as passages, array_to_string(resolved, ',') as resolved, md5(asked) as asked_md5, ids is not null as told from {_ASKED}",
    "structured_replies": _STRUCTURED,
    "answers_assembled": _ASSEMBLED,
    "answer_sources": _SOURCES,
}
