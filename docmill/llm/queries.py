"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmill.llm import bpe, collocations, jaccardjoin, maskedlm, nndescent, packing, periodicruns, quality, simhash, suffixdedup, tokenfile, toxicity, warc
from docmill.sources.tables import read_table


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_digests(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.component_ids(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit_labelled(docs, read_table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(read_table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return maskedlm.score(docs, maskedlm.train(docs))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_digests(read_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def planted_order(keys: pa.Array, before: np.ndarray) -> np.ndarray:
    """The word that stands at each place once a tenth of the documents, by the checksum of their id, repeat a
    stretch of their words up to their end."""
    place = np.arange(before[-1])
    for key, first, n in zip(keys.to_pylist(), before[:-1].tolist(), np.diff(before).tolist(), strict=True):
        h = crc32(str(key).encode()) if key is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        place[first + a : first + n] = first + a + np.arange(n - a) % period
    return place


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicruns.digests(periodicruns.detect(read_table(spark, sf_dir, "documents"), reorder=planted_order))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
    "pipeline": pipeline,
}
_SHINGLES = r"""s as materialized (select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh
  from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents)),
u as materialized (select doc_id, len(sh) as n, unnest(sh) as x from s),
l as materialized (select a, b from (select p.doc_id as a, q.doc_id as b, any_value(p.n) as na, any_value(q.n) as nb, count(*) as c from u p join u q on p.x = q.x and p.doc_id <> q.doc_id group by 1, 2)
  where 100 * c >= 80 * (na + nb - c))"""

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": f"""with recursive {_SHINGLES},
r(doc_id, reach) as (select doc_id, doc_id from s union select r.doc_id, l.b from r join l on l.a = r.reach)
select s.doc_id, any_value(len(sh))::bigint as n_shingles, min(reach) as component_id from s join r on r.doc_id = s.doc_id group by 1""",
    "op6_warc": """select page_id, n as payload_bytes, d as payload_digest, case when n < 100 or page_id = first then 'response' else 'revisit' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from (select *, min(page_id) over (partition by d) as first from (select page_id, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as d from pages))""",
    "op12_collocations": r"""with p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
g as (select lang, k, x, count(*) as f from (select lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) as x from p, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k) group by all),
f as materialized (select * from g where f >= 30),
n as (select lang, sum(f)::bigint as n from g where k = 1 group by 1),
c as (select *, unnest(range(1, k)) as cut from f where k > 1),
s as (select c.lang, c.k, c.x, c.f as a, l.f as l, r.f as r, ((2000000::hugeint * c.f) // (l.f + r.f))::bigint as score, cut
  from c join f l on l.lang = c.lang and l.x = c.x[:cut] join f r on r.lang = c.lang and r.x = c.x[cut + 1:]),
b as (select * from s qualify row_number() over (partition by lang, x order by score, cut) = 1),
q as (select distinct lang, k, f, x[i:i + m - 1] as x from f, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as i) where m < k and i + m - 1 <= k),
d as (select b.* from b where not exists (select 1 from q where q.lang = b.lang and q.x = b.x and 100 * q.f >= 80 * b.a)),
o as (select *, array_to_string(x, ' ') as phrase from d)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o) join n using (lang) where rank <= 2000""",
}
