"""Query op8: the n-gram Jaccard join over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moderix.llm import jaccard_join

WORDS, NUM, DEN = 4, 85, 100


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join.components(docs.select("doc_id", "text"), WORDS, NUM, DEN)


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLE_SQL = {
    "op8_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
t as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
e as (
  select distinct doc_id, g from (select doc_id, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o as g from t window o as (partition by doc_id order by i)) where g is not null
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 3),
n as (select w.doc_id, count(e.g) as n_shingles from w left join e on e.doc_id = w.doc_id group by 1),
p as (
  select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2),
l as (
  select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v
  where 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, node) as (
  select doc_id, doc_id from n union select r.doc_id, l.v from r join l on r.node = l.u)
select n.doc_id, n.n_shingles, min(r.node) as component_id from n join r on r.doc_id = n.doc_id group by 1, 2
"""
}
