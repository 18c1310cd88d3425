"""The store's relations derived from the driver's tables, in Spark and in SQL.

``events`` gives comments, decisions, scores per channel, patterns, moderator actions and request metrics; ``customer``
gives sessions; ``labels`` with ``documents`` gives scored evaluation rows. Times are microseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31 00:00:00, the time at which all panel queries are asked.
NOW_US = 1_706_659_200_000_000
DAY_US, HOUR_US, MINUTE_US = 86_400_000_000, 3_600_000_000, 60_000_000

OFFENSES = {"click": "A1", "error": "A2", "purchase": "B1", "signup": "B2", "view": "B4"}
ACTIONS = ("approve", "hide", "remove", "queue", "false_positive")
VERDICTS = ("clean", "nudge", "review", "escalate", "block")
PATTERNS = (("LEET", 3), ("REPEAT", 4), ("SPACED", 5), ("HOMOGLYPH", 7), ("PHONETIC", 8), ("DEASCII", 10))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def pick(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in names)), (i + 1).cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select("event_id", micros(F.col("ts")).alias("us"), "user_id", "event_type", "value", k.alias("k"))

    @cached_property
    def sessions(self) -> DataFrame:
        c = self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"), F.col("c_nationkey").cast("long").alias("ip"))
        return c.join(self.raw("events").select(F.col("user_id").alias("id")), "id", "left_semi")

    @cached_property
    def comments(self) -> DataFrame:
        k = F.col("k")
        return self.ev.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.concat("event_type", F.lit(" post "), k.cast("string")).alias("raw_text"),
            F.col("value").alias("latency_ms"), F.when(k % 5 != 0, k * 0.5).alias("queue_wait_ms"), (k % 2 == 0).alias("from_cache"),
            F.when(k % 11 != 0, k % 7 == 0).alias("binary_fired"), F.col("us").alias("created_us"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        k = F.col("k")
        types = F.when((k % 6).isin(0, 5), F.array().cast("array<string>")).when(k % 4 == 0, F.array(F.lit("B2"), F.lit("A1"))).otherwise(F.array(F.lit("A1")))
        return self.ev.select(F.col("event_id").alias("comment_id"), F.when(k % 6 < 5, pick(VERDICTS, F.least(k % 6, F.lit(4)))).alias("final_action"), types.alias("fired_types"), (k % 13 == 0).alias("degraded"))

    @cached_property
    def scores(self) -> DataFrame:
        """One row for each comment and channel."""
        code = F.create_map(*(F.lit(x) for kv in OFFENSES.items() for x in kv))[F.col("event_type")]
        both = F.array(F.struct(F.lit("raw").alias("channel"), (F.col("value") / 500).alias("score")), F.struct(F.lit("normalized").alias("channel"), (F.col("k") / 100).alias("score")))
        rows = self.ev.select(F.col("event_id").alias("comment_id"), code.alias("offense_type"), F.col("us").alias("created_us"), F.explode(both).alias("x"))
        return rows.select("comment_id", "offense_type", "x.channel", "x.score", F.lit(0.1).alias("threshold"), (F.col("x.score") >= 0.1).alias("fired"), "created_us")

    @cached_property
    def actions(self) -> DataFrame:
        k = F.col("k")
        return self.ev.filter("event_type = 'click'").select(F.col("event_id").alias("id"), (F.col("event_id") - k).alias("comment_id"), pick(ACTIONS, k % 5).alias("action"), F.when(k % 9 != 0, F.col("user_id")).alias("session_id"), F.col("us").alias("created_us"))

    @cached_property
    def metrics(self) -> DataFrame:
        return self.ev.select(F.col("event_type").alias("endpoint"), F.when(F.col("k") % 20 == 0, 503).otherwise(201).alias("status_code"), F.col("value").alias("latency_ms"), F.col("us").alias("created_us"))

    @cached_property
    def patterns(self) -> DataFrame:
        codes = F.filter(F.array(*(F.when(F.col("k") % m == 0, F.lit(c)) for c, m in PATTERNS)), lambda x: x.isNotNull())
        return self.ev.select(F.col("event_id").alias("comment_id"), F.col("us").alias("created_us"), codes.alias("codes"))

    @cached_property
    def scored(self) -> DataFrame:
        """row_id, gold, p, p2, slice: two systems' scores of the labelled documents."""
        d = F.col("doc_id")
        p = F.round((F.col("toxic") * 40 + d * 37 % 61) / 101.0, 4)
        p2 = F.round((F.col("toxic") * 30 + d * 53 % 71) / 101.0, 4)
        return self.raw("labels").join(self.raw("documents").select("doc_id", "n_chars"), "doc_id").select(d.alias("row_id"), F.col("toxic").cast("int").alias("gold"), p.alias("p"), p2.alias("p2"), F.when(d % 3 == 0, "hit").otherwise("free").alias("slice"), "n_chars")


#: The same relations for the oracle; queries put their own SELECT behind it.
SQL = f"""
with recursive ev as (
  select event_id, epoch_us(ts) as us, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events),
sessions as (select c_custkey as id, c_name as nickname, cast(c_nationkey as bigint) as ip from customer where c_custkey in (select user_id from events)),
comments as (
  select event_id as id, user_id as session_id, event_type || ' post ' || k as raw_text, value as latency_ms, case when k % 5 <> 0 then k * 0.5::double end as queue_wait_ms,
    k % 2 = 0 as from_cache, case when k % 11 <> 0 then k % 7 = 0 end as binary_fired, us as created_us from ev),
decisions as (
  select event_id as comment_id, case k % 6 when 0 then 'clean' when 1 then 'nudge' when 2 then 'review' when 3 then 'escalate' when 4 then 'block' end as final_action,
    case when k % 6 in (0, 5) then []::varchar[] when k % 4 = 0 then ['B2', 'A1'] else ['A1'] end as fired_types, k % 13 = 0 as degraded from ev),
scores as (
  select event_id as comment_id, case event_type when 'click' then 'A1' when 'error' then 'A2' when 'purchase' then 'B1' when 'signup' then 'B2' when 'view' then 'B4' end as offense_type,
    channel, case channel when 'raw' then value / 500 else k / 100 end as score, 0.1::double as threshold, case channel when 'raw' then value / 500 else k / 100 end >= 0.1::double as fired, us as created_us
  from ev cross join (values ('raw'), ('normalized')) c(channel)),
actions as (
  select event_id as id, event_id - k as comment_id, case k % 5 when 0 then 'approve' when 1 then 'hide' when 2 then 'remove' when 3 then 'queue' else 'false_positive' end as action,
    case when k % 9 <> 0 then user_id end as session_id, us as created_us from ev where event_type = 'click'),
metrics as (select event_type as endpoint, case when k % 20 = 0 then 503 else 201 end as status_code, value as latency_ms, us as created_us from ev),
patterns as (
  select event_id as comment_id, us as created_us, list_filter([{", ".join(f"case when k % {m} = 0 then '{c}' end" for c, m in PATTERNS)}], lambda x: x is not null) as codes from ev),
scored as (
  select doc_id as row_id, cast(toxic as int) as gold, round((toxic * 40 + doc_id * 37 % 61) / 101.0::double, 4) as p, round((toxic * 30 + doc_id * 53 % 71) / 101.0::double, 4) as p2,
    case when doc_id % 3 = 0 then 'hit' else 'free' end as slice, n_chars from labels join documents using (doc_id))
"""


def counted(sql: str) -> str:
    """``count_if(x)`` as a filtered count, whose type is BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) filter (where {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def book() -> tuple[dict, dict, Callable]:
    """A new register: queries by name, their SQL, and the decorator that fills both."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(name: str, sql: str | None = None, more: str = "") -> Callable:
        """sql follows the relations and ``more`` relations."""

        def put(f: Callable) -> Callable:
            queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                oracle[name] = SQL + counted(more + sql)
            return f

        return put

    return queries, oracle, query
