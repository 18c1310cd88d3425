"""Query op3: stupid-backoff scores of all documents by trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix.llm import lm_scoring


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = lm_scoring.scored(docs)
    return got.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLE_SQL = {
    "op3_lm_scoring": r"""
with l as (
  select doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), ' +') as ws
  from documents),
t as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from l where ws <> ['']),
p as (select doc_id, i, w, lag(w) over o as h, lag(w, 2) over o as g from t window o as (partition by doc_id order by i)),
u as (select w, count(*) as c from t group by w),
b as (select h, w, count(*) as c from p where h is not null group by h, w),
r as (select g, h, w, count(*) as c from p where g is not null group by g, h, w),
n as (select count(*) as n from t),
s as (
  select p.doc_id, case when r.c >= 2 then ln(r.c / gh.c)
    else case when p.g is null then 0 else ln(0.4::double) end
      + case when b.c >= 2 then ln(b.c / v.c) else case when p.h is null then 0 else ln(0.4::double) end + ln(u.c / n.n) end end as s
  from p join u on u.w = p.w left join b on b.h = p.h and b.w = p.w left join u v on v.w = p.h
  left join r on r.g = p.g and r.h = p.h and r.w = p.w left join b gh on gh.h = p.g and gh.w = p.h cross join n)
select d.doc_id, count(s.s) as n_words, round(coalesce(sum(s.s), 0), 4) as log_score, round(avg(s.s), 4) as mean_log_score
from documents d left join s on s.doc_id = d.doc_id group by d.doc_id
"""
}
