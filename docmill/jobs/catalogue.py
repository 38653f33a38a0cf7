"""Registered queries over the given tables, and their DuckDB equivalents.

Identifiers are made from columns (``ALARM <doc_id % 500>`` and the like) where the tables' prose holds
none. Each query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.config import DEFAULT_CODE_PATTERNS, NOT_FOUND, RetrievalConfig
from docmill.functions import answers, codes
from docmill.functions import text as T
from docmill.operators import blocks as B
from docmill.operators import answering, chunking, evaluate, lifecycle, prompts, retrieval
from docmill.sources.documents import base_name
from docmill.sources.tables import read_table

SEARCH = RetrievalConfig(top_k=6, min_score=0.25)
RULES = tuple(r for r in DEFAULT_CODE_PATTERNS if r.name in ("alarm", "stop", "part"))


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 50 == 0)


def semantic_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = retrieval.semantic(_asked(v), v, RetrievalConfig(top_k=6, min_score=-2.0), exclude_self=True)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def semantic_threshold(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = retrieval.semantic(_asked(v), v, SEARCH, exclude_self=True)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_COSINE = "list_cosine_similarity(q.embedding::double[], c.embedding::double[])"
_SEMANTIC = f"""select query_id, chunk_id, rank, round(score, 6) as score from (
  select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
    select q.vec_id as query_id, c.vec_id as chunk_id, {_COSINE} as score
    from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0))
where rank <= 6"""


def _vector_codes(rows: DataFrame) -> DataFrame:
    """Each vector's identifier: its label within its hundred."""
    return rows.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("LBL-"), F.col("label"), F.lit("-"), F.floor(F.col("vec_id") / 100)).alias("value"))


def _hybrid(spark, sf_dir):
    table = read_table(spark, sf_dir, "embeddings")
    v = _vectors(spark, sf_dir)
    index = _vector_codes(table)
    asked = index.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "value")
    by_code = retrieval.lookup(asked, index).where("query_id <> chunk_id")
    return retrieval.hybrid(retrieval.semantic(_asked(v), v, SEARCH, exclude_self=True), by_code, SEARCH, index)


def hybrid_retrieve(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), "match_type")


_HYBRID = f"""(with s as ({_SEMANTIC.replace("round(score, 6) as score", "score")} and score >= 0.25),
codes as (select vec_id, 'LBL-' || label || '-' || (vec_id // 100) as value from embeddings),
k as (select a.vec_id as query_id, b.vec_id as chunk_id from codes a join codes b on a.value = b.value and a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select coalesce(s.query_id, k.query_id) as query_id, coalesce(s.chunk_id, k.chunk_id) as chunk_id,
  coalesce(s.score, 0) + case when k.query_id is null then 0 else 1 end as score,
  case when k.query_id is null then 'semantic' when s.query_id is null then 'code' else 'hybrid' end as match_type
from s full join k on s.query_id = k.query_id and s.chunk_id = k.chunk_id)"""


def hybrid_match_mix(spark, sf_dir):
    return _hybrid(spark, sf_dir).groupBy("match_type").agg(F.count("*").alias("hits"), F.round(F.sum("score"), 4).alias("total"))


def eval_rates(spark, sf_dir):
    """Queries are graded by whether a hit shares their label; the label is the expected code."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    v = _vectors(spark, sf_dir)
    hits = retrieval.semantic(_asked(v), v, SEARCH, exclude_self=True).join(table.toDF("chunk_id", "hit_label"), "chunk_id")
    own = hits.groupBy("query_id").agg(F.collect_set(F.col("hit_label").cast("string")).alias("codes"), F.collect_set((F.col("chunk_id") % 10).cast("int")).alias("pages"))
    none = F.array().cast("array<string>")
    cases = _asked(table).join(own, F.col("id") == F.col("query_id"), "left").select(
        F.col("query_id").isNotNull().alias("found"), (F.col("id") % 3 != 0).alias("should_find"),
        F.when(F.col("id") % 100 == 0, F.array(F.col("label").cast("string"))).otherwise(none).alias("expected_codes"), F.coalesce("codes", none).alias("codes"),
        F.array((F.col("label")).cast("int")).alias("expected_pages"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"),
    )
    out = evaluate.rates(evaluate.outcomes(cases))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns if c != "cases"), "cases")


_EVAL = f"""with s as ({_SEMANTIC.replace("round(score, 6) as score", "score")} and score >= 0.25),
o as (select s.query_id, list(distinct e.label) as codes, list(distinct s.chunk_id % 10) as pages from s join embeddings e on e.vec_id = s.chunk_id group by 1),
g as (select o.query_id is not null as found, e.vec_id % 3 <> 0 as should_find, e.vec_id % 100 = 0 as graded,
  coalesce(list_contains(codes, e.label), false) as ok, coalesce(list_contains(pages, e.label), false) as page_ok
  from embeddings e left join o on o.query_id = e.vec_id where e.vec_id % 50 = 0)
select round(count(*) filter (found = should_find) / count(*), 6) as found_accuracy,
  round(count(*) filter (page_ok) / count(*), 6) as page_hit_rate,
  round(case when count(*) filter (graded) = 0 then 1.0 else count(*) filter (graded and ok) / count(*) filter (graded) end, 6) as code_resolution_rate,
  round(case when count(*) filter (not should_find) = 0 then 1.0 else count(*) filter (not should_find and not found) / count(*) filter (not should_find) end, 6) as not_found_accuracy,
  count(*) as cases from g"""


def _coded(spark, sf_dir):
    """Documents with identifiers put before their text."""
    made = F.concat(F.lit("ALARM "), F.col("doc_id") % 500, F.lit("; STOP CODE "), F.col("doc_id") % 90, F.lit(", part no. AB-"), F.col("doc_id"), F.lit("-"), F.col("n_chars"), F.lit(" : "), F.coalesce("text", F.lit("")))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), codes.extract(made, RULES).alias("codes"))


def code_postings(spark, sf_dir):
    index = retrieval.postings(_coded(spark, sf_dir))
    return index.groupBy("value").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


_WIDE = r"regexp_replace('ALARM ' || (doc_id % 500) || '; STOP CODE ' || (doc_id % 90) || ', part no. AB-' || doc_id || '-' || n_chars || ' : ' || coalesce(text, ''), '[^A-Za-z0-9]', '\0\0', 'g')"
_POSTINGS = f"""(select distinct doc_id, unnest(
  list_transform(regexp_extract_all({_WIDE}, '(?i)(?:^|[^A-Za-z0-9])(?:ALARM|ALM|AL)[\\s\\-:_]*(\\d{{1,4}}[A-Z]?)', 1), lambda x: 'AL-' || upper(x))
  || list_transform(regexp_extract_all({_WIDE}, '(?i)(?:^|[^A-Za-z0-9])(?:STOP[\\s\\-]{{0,2}}CODE|STOP|SC)[\\s\\-:_]*(\\d{{1,4}})', 1), lambda x: 'SC-' || upper(x))
  || list_transform(regexp_extract_all({_WIDE}, '(?i)(?:^|[^A-Za-z0-9])(?:PART\\s+(?:NO(?:\\.\\.)?|NUMBER)|PART|P(?://)?N)[\\s\\-:#]*([A-Z0-9]{{2,}}(?:--[A-Z0-9]+)+)', 1), lambda x: 'PN-' || replace(upper(x), '--', '-'))
) as value from documents)"""


def _query_codes(spark, sf_dir):
    """Of every document divisible by 50, the code of its alarm, and one that no document has."""
    asked = read_table(spark, sf_dir, "documents").where(F.col("doc_id") % 50 == 0)
    question = F.concat(F.lit("what is alarm "), F.col("doc_id") % 500, F.lit(" or stop 9999?"))
    return asked.select(F.col("doc_id").alias("query_id"), F.explode(codes.extract(question, RULES)["value"]).alias("value"))


def code_lookup(spark, sf_dir):
    hits = retrieval.lookup(_query_codes(spark, sf_dir), retrieval.postings(_coded(spark, sf_dir)))
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("chunk_id").alias("first_chunk"))


def resolved_codes(spark, sf_dir):
    return retrieval.resolved(_query_codes(spark, sf_dir), retrieval.postings(_coded(spark, sf_dir))).select("query_id", "value")


def _document_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return B.page_lines(docs.withColumn("page", F.lit(1)), "doc_id", "source")


_LINES = r"""(select doc_id, source, line_no, line, regexp_replace(line, '^\s+|\s+$', '', 'g') as s from (
  select doc_id, source, unnest(range(len(l))) as line_no, unnest(l) as line from (
    select doc_id, source, case when l[-1] = '' then l[:-2] else l end as l from (select doc_id, source, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c]') as l from documents))))"""
_CELLS = "list_transform(string_split(line, '|'), lambda x: trim(x))"
_KINDS = rf"""(select *, case when s = '' then 'blank'
  when regexp_matches(s, '(?:[.·]\s?){{4,}}|(?:-\s){{3,}}') and regexp_matches(s, '\d+\s*[-–]\s*\d+\s*$') then 'navigation'
  when contains(line, '|') and len(cells) >= 2 then 'table'
  when regexp_matches(s, '^\s*#{{1,6}}\s+(.+?)\s*#*\s*$') then 'heading'
  when regexp_matches(s, '\pL') and length(s) between 2 and 60 and s = upper(s) and not regexp_matches(s, '[.:,;]$')
    and not regexp_matches(s, '(?:[.·]\s?){{4,}}|(?:-\s){{3,}}') and not regexp_matches(s, '\d+\s*[-–]\s*\d+\s*$') then 'heading'
  when regexp_matches(line, '(?i)^\s*(?:\d+[.)]\s+|step\s+\d+\b)') then 'step' else 'paragraph' end as kind from (
    select *, case when len(c1) > 0 and c1[-1] = '' then c1[:-2] else c1 end as cells from (
      select *, case when c0[1] = '' then c0[2:] else c0 end as c1 from (select *, {_CELLS} as c0 from {_LINES})))) """


def line_kinds(spark, sf_dir):
    lines = B.classify(_document_lines(spark, sf_dir))
    return lines.groupBy("source", "kind").agg(F.count("*").alias("lines"), F.sum(F.length("s")).alias("chars"))


def _blocks(spark, sf_dir):
    return B.blocks(B.classify(_document_lines(spark, sf_dir)), "doc_id")


def table_blocks(spark, sf_dir):
    own = _blocks(spark, sf_dir).where("kind = 'table'")
    return own.select("doc_id", F.col("island").alias("island"), F.size("rows").cast("long").alias("n_rows"), F.md5("text").alias("text_md5"))


_ISLANDS = f"""(select *, sum(fresh) over (partition by doc_id order by line_no) as island from (
  select *, case when kind in ('table', 'paragraph') and lag(kind) over (partition by doc_id order by line_no) = kind then 0 else 1 end as fresh from {_KINDS}))"""


def section_carry(spark, sf_dir):
    """Of every document, its blocks by the section that they stand in."""
    return _blocks(spark, sf_dir).groupBy("doc_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("blocks"), F.min("island").alias("first_island"))


_SECTION = f"""with b as (select doc_id, island, kind, min(line_no) as place, any_value(s) as s,
    count(*) filter (kind = 'table' and not list_bool_and(list_transform(cells, lambda x: x = '' or regexp_matches(x, '^:?-{{2,}}:?$')))) as solid
  from {_ISLANDS} where kind not in ('blank', 'navigation') group by all),
p as (select *, case when kind = 'heading' then coalesce(nullif(regexp_extract(s, '^\\s*#{{1,6}}\\s+(.+?)\\s*#*\\s*$', 1), ''), s) end as head from b where kind <> 'table' or solid > 0)
select doc_id, coalesce(section, '') as section, count(*) as blocks, min(island)::bigint as first_island from (
  select doc_id, island, last_value(head ignore nulls) over (partition by doc_id order by place rows unbounded preceding) as section from p) group by 1, 2"""


def chunk_pack(spark, sf_dir):
    """Greedy packing of every document's lines to the default budget."""
    rows = _document_lines(spark, sf_dir).select("doc_id", "line_no", "line")
    packed = chunking.pack(rows, ["doc_id"], "line_no", F.length("line"), F.lit(1200))
    return packed.groupBy("doc_id", F.col("group").cast("long").alias("chunk_group")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_PACK = f"""with recursive l as materialized (select doc_id, line_no, length(line) as n from {_LINES}),
p as (select doc_id, line_no, n, 0 as g, n as used from l where line_no = 0
  union all select l.doc_id, l.line_no, l.n, case when p.used + l.n > 1200 then p.g + 1 else p.g end, case when p.used + l.n > 1200 then l.n else p.used + l.n end
  from p join l on l.doc_id = p.doc_id and l.line_no = p.line_no + 1)
select doc_id, g::bigint as chunk_group, count(*) as lines, sum(n)::bigint as chars from p group by 1, 2"""


def chunk_ids(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", chunking.chunk_id(F.col("doc_id"), F.lit(0), F.lit(1), F.coalesce("text", F.lit(""))).alias("chunk_id"))


def content_hashes(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", chunking.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))


def _source_pages(spark, sf_dir):
    """A source as a document and each of its documents as a page."""
    docs = read_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return B.page_lines(docs, "source")


def header_footer(spark, sf_dir):
    return B.running_forms(_source_pages(spark, sf_dir), "source")


_SOLID = rf"(select source, doc_id, line_no, s from {_LINES} where s <> '')"
_EDGES = rf"""(select source, doc_id, edge, line_no, regexp_replace(s, '\d+', '#', 'g') as form from (
  select *, 'header' as edge from {_SOLID} qualify row_number() over (partition by doc_id order by line_no) = 1
  union all select *, 'footer' as edge from {_SOLID} qualify row_number() over (partition by doc_id order by line_no desc) = 1 and count(*) over (partition by doc_id) > 1))"""
_FORMS = f"""(select distinct e.source, form from (select source, edge, form, count(*) as n from {_EDGES} group by all) e
  join (select source, count(distinct doc_id) as pages from {_LINES} group by 1) p on p.source = e.source where n >= greatest(4, pages // 10))"""


def header_strip(spark, sf_dir):
    left = B.drop_running(_source_pages(spark, sf_dir), "source")
    return left.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def _registry(spark, sf_dir):
    """What an index would hold: documents not divisible by 7; of those divisible by 10 an older text."""
    docs = read_table(spark, sf_dir, "documents").withColumn("source_path", F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    old = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("old "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    listing = docs.select("source_path", chunking.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))
    return listing, docs.where("doc_id % 7 <> 0").select("source_path", chunking.content_hash(old.cast("binary")).alias("content_hash"))


def update_diff(spark, sf_dir):
    listing, registry = _registry(spark, sf_dir)
    return lifecycle.actions(listing, registry).select("source_path", "action")


def remove_match(spark, sf_dir):
    """Pages that a removal takes out which names the base names of pages divisible by 50."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), "page_id")
    named = pages.where("page_id % 50 = 0").select(base_name(F.col("source_path")).alias("target")).where("target <> ''")
    return pages.join(lifecycle.removal(pages, named), "source_path", "left_semi").select("page_id", "source_path")


def index_info(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return lifecycle.info(docs.select(F.col("source").alias("source_path")))


def prompt_render(spark, sf_dir):
    """Every conversation's first turn asks; its other turns are the passages."""
    turns = read_table(spark, sf_dir, "conversations")
    first = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "text", "role", F.first("text").over(first).alias("question"), F.row_number().over(first).alias("rank"))
    none = F.array().cast("array<string>")
    shown = prompts.passage(F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")), F.col("role"), none, F.lit("paragraph"), F.col("text"))
    made = prompts.user_prompts(rows.where("rank > 1").select(F.col("conv_id").alias("query_id"), "question", "rank", shown.alias("passage")))
    return made.select("query_id", F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("prompt_md5"))


_PROMPT = """select conv_id as query_id, length(prompt) as chars, md5(prompt) as prompt_md5 from (
select conv_id, 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Context passages:' || string_agg(chr(10) || chr(10) || '[' || conv_id || '-' || turn || ']' || case when role <> '' then ' (section: ' || role || ')' else '' end || chr(10) || text, '' order by rank) as prompt
from (select *, first_value(text) over (partition by conv_id order by turn) as question, row_number() over (partition by conv_id order by turn) as rank from conversations) where rank > 1 group by 1)"""


def _replies(spark, sf_dir):
    """Replies over the documents' text: some cite passages, some are or hold the not-found sentence."""
    docs = read_table(spark, sf_dir, "documents")
    own = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)
    other = F.substring(F.md5((F.col("doc_id") + 1).cast("string")), 1, 16)
    said = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Sorry: "), F.lit(NOT_FOUND), F.lit(" ["), own, F.lit("]")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("  ["), own, F.lit(", "), other, F.lit("] \nend\n"), F.lit(NOT_FOUND)))
        .otherwise(F.coalesce("text", F.lit("")))
    )
    return docs.select("doc_id", said.alias("reply"), F.array(other, F.lit("abcdef0123456789"), own, F.lit("0123456789abcdef")).alias("offered"))


_REPLIES = f"""(select doc_id, case when doc_id % 4 = 0 then 'Sorry: {NOT_FOUND} [' || md5(doc_id::varchar)[:16] || ']'
 when doc_id % 4 = 1 then coalesce(text, '') || '  [' || md5(doc_id::varchar)[:16] || ', ' || md5((doc_id + 1)::varchar)[:16] || '] ' || chr(10) || 'end' || chr(10) || '{NOT_FOUND}' else coalesce(text, '') end as reply,
 [md5((doc_id + 1)::varchar)[:16], 'abcdef0123456789', md5(doc_id::varchar)[:16], '0123456789abcdef'] as offered from documents)"""
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '\s*\[[0-9a-f][0-9a-f,;\s]*\]', '', 'g'), '[ \t]{2,}', ' ', 'g'), ' +\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def cited_ids(spark, sf_dir):
    rows = _replies(spark, sf_dir)
    return rows.select("doc_id", F.array_join(answers.cited_or_first(F.col("reply"), F.col("offered")), ",").alias("cited"), F.size(answers.cited_ids(F.col("reply"), F.col("offered"))).cast("long").alias("n_cited"))


_CITED = f"""select doc_id, array_to_string(case when len(c) > 0 then c else offered[:3] end, ',') as cited, len(c)::bigint as n_cited from (
 select doc_id, offered, case when doc_id % 4 = 0 then [offered[3]] when doc_id % 4 = 1 then [offered[3], offered[1]] else [] end as c from {_REPLIES})"""


def strip_markers(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", F.md5(answers.strip_markers(F.col("reply"))).alias("shown_md5"))


def clean_answer(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", F.md5(answers.clean_answer(F.col("reply"))).alias("shown_md5"))


_CLEAN = rf"""select doc_id, md5(regexp_replace(array_to_string(list_filter(string_split_regex(shown, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x) <> '{NOT_FOUND}'), chr(10)), '^\s+|\s+$', '', 'g')) as shown_md5
from (select doc_id, {_STRIPPED} as shown from {_REPLIES})"""


def not_found_flag(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", answers.is_not_found(F.col("reply")).alias("not_found"))


_NOT_FOUND = rf"""select doc_id, core = t or (contains(core, t) and length(core) <= length(t) + 30) as not_found from (
 select doc_id, regexp_replace(regexp_replace(lower({_STRIPPED}), '[.!]+$', ''), '^\s+|\s+$', '', 'g') as core, '{NOT_FOUND.lower().rstrip(".")}' as t from {_REPLIES})"""


def structured_parse(spark, sf_dir):
    """JSON replies made of the events' properties: plain, fenced, within prose, or broken."""
    events = read_table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"found": '), (F.col("event_id") % 3 != 0).cast("string"), F.lit(', "answer": " value '), F.col("event_id"), F.lit(' ", "steps": ["1. '), F.col("event_type"), F.lit('", "- ", "go"], "used": ["['), F.col("user_id"), F.lit(']", "x"]}'))
    kind = F.col("event_id") % 4
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise("no reply")
    got = events.select("event_id", answers.parse_structured(reply, F.array(F.col("user_id").cast("string"))).alias("a"))
    shown = answers.render_structured(F.col("a.answer"), F.col("a.steps"))
    return got.select("event_id", F.col("a").isNotNull().alias("parsed"), F.col("a.found").alias("found"), shown.alias("shown"), F.array_join("a.used", ",").alias("used"))


_STRUCTURED = """select event_id, event_id % 4 <> 3 as parsed, case when event_id % 4 <> 3 then event_id % 3 <> 0 end as found,
 case when event_id % 4 <> 3 then 'value ' || event_id || chr(10) || '1. ' || event_type || chr(10) || '2. -' || chr(10) || '3. go' end as shown,
 case when event_id % 4 <> 3 then user_id::varchar end as used from events"""


def referenced_codes(spark, sf_dir):
    """Each source's codes in order of its documents, unless the source's number is even: then its own."""
    rows = read_table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.array(F.concat(F.lit("AL-"), F.col("doc_id") % 40), F.concat(F.lit("SC-"), F.col("doc_id") % 30))).alias("at", "code"))
    # a source may hold a third of all rows: each code's first place is kept before anything is gathered
    first = rows.groupBy("source", "code").agg(F.min(F.struct("doc_id", "at")).alias("place"))
    made = first.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "code")))["code"].alias("own"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    resolved = F.when(number % 2 == 0, F.array(F.concat(F.lit("SRC-"), number))).otherwise(F.array().cast("array<string>"))
    return made.select("source", F.array_join(prompts.referenced_codes(resolved, F.array("own")), ",").alias("codes"))


_REFERENCED = """select source, case when regexp_extract(source, '(\\d+)$', 1)::int % 2 = 0 then 'SRC-' || regexp_extract(source, '(\\d+)$', 1)::int
 else string_agg(code, ',' order by place) end as codes from (
 select source, code, min(place) as place from (select source, unnest(['AL-' || (doc_id % 40), 'SC-' || (doc_id % 30)]) as code, 2 * (row_number() over (partition by source order by doc_id)) + unnest([0, 1]) as place from documents) group by 1, 2) group by 1"""


def provenance_dedup(spark, sf_dir):
    """Of every conversation, whose turns cite a document and a section each, the different places in the order in
    which they are first cited."""
    turns = read_table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    cited = F.struct("turn", F.concat(F.lit("doc-"), F.length("text") % 3).alias("source_path"), F.lit(1).alias("page"), F.col("role").alias("section"))
    answered = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.sort_array(F.collect_list(cited)).alias("citations"))
    return answering.provenance(answered).select("query_id", F.col("position").cast("long").alias("position"), "source_path", "section")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_retrieve, hybrid_match_mix, semantic_topk, semantic_threshold, eval_rates, code_postings, code_lookup, resolved_codes, line_kinds,
        table_blocks, section_carry, chunk_pack, chunk_ids, content_hashes, header_footer, header_strip, update_diff, remove_match, index_info,
        prompt_render, cited_ids, strip_markers, clean_answer, not_found_flag, structured_parse, referenced_codes, provenance_dedup,
    )
}

ORACLES: dict[str, str] = {
    "semantic_topk": _SEMANTIC,
    "semantic_threshold": _SEMANTIC + " and score >= 0.25",
    "hybrid_retrieve": f"select query_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, chunk_id, round(score, 6) as score, match_type from {_HYBRID}",
    "hybrid_match_mix": f"select match_type, count(*) as hits, round(sum(score), 4) as total from {_HYBRID} group by 1",
    "eval_rates": _EVAL,
    "code_postings": f"select value, count(*) as chunks, min(doc_id) as first_chunk from {_POSTINGS} group by 1",
    "code_lookup": f"""select query_id, count(*) as hits, min(doc_id) as first_chunk from (
  select distinct q.query_id, p.doc_id from (select doc_id as query_id, unnest(['AL-' || (doc_id % 500), 'SC-9999']) as value from documents where doc_id % 50 = 0) q join {_POSTINGS} p on p.value = q.value) group by 1""",
    "resolved_codes": f"select query_id, value from (select doc_id as query_id, unnest(['AL-' || (doc_id % 500), 'SC-9999']) as value from documents where doc_id % 50 = 0) where value in (select value from {_POSTINGS})",
    "line_kinds": f"select source, kind, count(*) as lines, sum(length(s))::bigint as chars from {_KINDS} group by 1, 2",
    "table_blocks": f"""select doc_id, island::bigint as island, count(*) as n_rows, md5(string_agg(array_to_string(cells, ' | '), chr(10) order by line_no)) as text_md5
  from {_ISLANDS} where kind = 'table' and not list_bool_and(list_transform(cells, lambda x: x = '' or regexp_matches(x, '^:?-{{2,}}:?$'))) group by 1, 2""",
    "section_carry": _SECTION,
    "chunk_pack": _PACK,
    "chunk_ids": "select doc_id, sha1(doc_id || '|0|1|' || coalesce(text, ''))[:16] as chunk_id from documents",
    "content_hashes": "select doc_id, sha256(coalesce(text, ''))[:16] as content_hash from documents",
    "header_footer": f"select source, form from {_FORMS}",
    "header_strip": f"""select source, count(*) as lines, sum(length(line))::bigint as chars from {_LINES} l
  where not exists (select 1 from {_EDGES} e join {_FORMS} f on f.source = e.source and f.form = e.form where e.doc_id = l.doc_id and e.line_no = l.line_no) group by 1""",
    "update_diff": "select source || '/' || doc_id || '.txt' as source_path, case when doc_id % 7 = 0 then 'added' when doc_id % 10 = 0 then 'refreshed' else 'skipped' end as action from documents",
    "remove_match": """with p as (select page_id, url, coalesce(string_split(url, '/')[-1], '') as name from pages),
  t as (select distinct name as target from p where page_id % 50 = 0 and name <> ''), exact as (select target from t where target in (select url from p)), loose as (select target from t where target not in (select target from exact))
  select page_id, url as source_path from p where url in (select target from exact) or name in (select target from loose) or exists (select 1 from loose where suffix(p.url, target))""",
    "index_info": "select source as source_path, count(*) as chunk_count from documents group by 1",
    "prompt_render": _PROMPT,
    "cited_ids": _CITED,
    "strip_markers": f"select doc_id, md5({_STRIPPED}) as shown_md5 from {_REPLIES}",
    "clean_answer": _CLEAN,
    "not_found_flag": _NOT_FOUND,
    "structured_parse": _STRUCTURED,
    "referenced_codes": _REFERENCED,
    "provenance_dedup": """select query_id, min(n) - 1 as position, source_path, section from (
  select conv_id as query_id, 'doc-' || (length(text) % 3) as source_path, role as section, row_number() over (partition by conv_id order by turn, 'doc-' || (length(text) % 3), role) as n from conversations where conv_id is not null and turn is not null) group by 1, 3, 4""",
}
