"""Queries of the panel: store relations, filters, joins, counts, series, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moderix.operators import panel
from moderix.plans.tables import DAY_US, HOUR_US, MINUTE_US, NOW_US, Tables, book

QUERIES, ORACLE_SQL, query = book()
WEEK, DAY = NOW_US - 7 * DAY_US, NOW_US - 3 * DAY_US
DETECTED = "(len(fired_types) > 0 or coalesce(binary_fired, false))"
STATUS = "case when latest in ('approve','hide','remove') then 'reviewed' when latest in ('queue','false_positive') then 'pending' when final_action is null or final_action in ('review','escalate') then 'pending' when final_action in ('block','nudge') then 'auto' else 'none' end"
ITEMS = f""", latest as (select comment_id, action as latest, created_us as latest_us from actions qualify row_number() over (partition by comment_id order by created_us desc, id desc) = 1),
items as (
  select c.*, s.nickname, s.ip, d.final_action, d.fired_types, d.degraded, l.latest, {STATUS} as status, {DETECTED} as detected
  from comments c join sessions s on s.id = c.session_id join decisions d on d.comment_id = c.id left join latest l on l.comment_id = c.id)
"""


def items_of(t: Tables) -> DataFrame:
    return panel.items(t.comments, t.sessions, t.decisions, t.actions)


@query("panel_overview", f"""
, x as (select *, created_us >= {WEEK} as cur from comments c join decisions d on d.comment_id = c.id where created_us >= {WEEK - 7 * DAY_US} and created_us < {NOW_US}),
y as (select *, {DETECTED} as det from x)
select count_if(cur) as analysed, count_if(not cur) as analysed_before, count_if(cur and det) as detected, count_if(not cur and det) as detected_before,
  count_if(cur and final_action in ('block','nudge')) as automatic, count_if(not cur and coalesce(final_action in ('block','nudge'), false)) as automatic_before,
  count_if(cur and final_action = 'review') as review, count_if(cur and final_action = 'escalate') as escalate, count_if(cur and final_action = 'block') as block,
  count_if(cur and final_action = 'nudge') as nudge, count_if(cur and final_action = 'clean') as clean, count_if(cur and final_action is null) as failed,
  case when count_if(not cur) <> 0 then round((count_if(cur) - count_if(not cur)) / count_if(not cur)::double * 1000) / 10 end as analysed_change,
  case when count_if(cur) <> 0 then round(count_if(cur and final_action in ('review','escalate')) / count_if(cur)::double * 1000) / 10 end as human_share
from y""")  # fmt: skip
def overview(t: Tables) -> DataFrame:
    rows = t.comments.filter((F.col("created_us") >= WEEK - 7 * DAY_US) & (F.col("created_us") < NOW_US)).join(t.decisions, F.col("id") == F.col("comment_id"))
    cur, det, act = F.col("created_us") >= WEEK, panel.detected(), F.col("final_action")
    auto = F.coalesce(act.isin("block", "nudge"), F.lit(False))
    got = rows.agg(
        F.count_if(cur).alias("analysed"), F.count_if(~cur).alias("analysed_before"), F.count_if(cur & det).alias("detected"), F.count_if(~cur & det).alias("detected_before"),
        F.count_if(cur & auto).alias("automatic"), F.count_if(~cur & auto).alias("automatic_before"),
        *(F.count_if(cur & (act == x)).alias(x) for x in ("review", "escalate", "block", "nudge", "clean")), F.count_if(cur & act.isNull()).alias("failed"),
    )
    return got.withColumn("analysed_change", panel.change_pct(F.col("analysed"), F.col("analysed_before"))).withColumn("human_share", panel.share_pct(F.col("review") + F.col("escalate"), F.col("analysed")))


@query("panel_items_page", f"select id, session_id, nickname, final_action, latest, status, detected, created_us from items where created_us < {DAY} order by created_us desc, id desc limit 26", ITEMS)
def items_page(t: Tables) -> DataFrame:
    return panel.page(items_of(t), 25, (DAY, 0)).select("id", "session_id", "nickname", "final_action", "latest", "status", "detected", "created_us")


@query("panel_items_filtered", f"select id, status, created_us from items where list_contains(fired_types, 'B2') and status = 'pending' and created_us >= {WEEK} and created_us < {NOW_US} and (contains(lower(raw_text), 'view') or contains(lower(nickname), 'view'))", ITEMS)
def items_filtered(t: Tables) -> DataFrame:
    return panel.matching(items_of(t), code="B2", state="pending", q="view", since=WEEK, until=NOW_US).select("id", "status", "created_us")


@query("panel_items_binary", "select id, final_action from items where coalesce(binary_fired, false) and final_action = 'review' and detected", ITEMS)
def items_binary(t: Tables) -> DataFrame:
    return panel.matching(items_of(t), code="binary_offensive", verdict="review", only_detected=True).select("id", "final_action")


@query("panel_search_literal", "select id from items where contains(lower(raw_text), '%') or contains(lower(nickname), '%')", ITEMS)
def search_literal(t: Tables) -> DataFrame:
    return panel.matching(items_of(t), q="%").select("id")


@query("panel_ids", "select id, status from items where id in (3, 5, 8, 13, 100000000)", ITEMS)
def by_ids(t: Tables) -> DataFrame:
    return panel.matching(items_of(t), ids=[3, 5, 8, 13, 100_000_000]).select("id", "status")


@query("panel_queue_counts", "select count_if(status = 'pending') as pending, count_if(status = 'pending' and detected) as pending_detected, count_if(status = 'reviewed') as reviewed, count_if(status = 'auto') as auto from items", ITEMS)
def queue_counts(t: Tables) -> DataFrame:
    s = F.col("status")
    return items_of(t).agg(F.count_if(s == "pending").alias("pending"), F.count_if((s == "pending") & F.col("detected")).alias("pending_detected"), F.count_if(s == "reviewed").alias("reviewed"), F.count_if(s == "auto").alias("auto"))


@query("panel_latest_action", "select comment_id, latest, latest_us from latest", ITEMS)
def latest_action(t: Tables) -> DataFrame:
    return panel.latest_actions(t.actions)


@query("feed_flagged_page", "select id, final_action, created_us from items where final_action is distinct from 'clean' order by created_us desc, id desc limit 21", ITEMS)
def feed(t: Tables) -> DataFrame:
    return panel.page(panel.flagged(items_of(t)), 20).select("id", "final_action", "created_us")


@query("feed_reasons", """, p as (select id from items where final_action is distinct from 'clean'),
b as (select comment_id, offense_type, max(score) as score from scores where fired and comment_id in (select id from p) group by 1, 2)
select comment_id as id, string_agg(offense_type || ':' || printf('%.4f', score), ' ' order by score desc, offense_type) as reasons from b group by 1""", ITEMS)
def feed_reasons(t: Tables) -> DataFrame:
    return panel.reasons(panel.flagged(items_of(t)), t.scores).select("id", F.array_join("reasons", " ").alias("reasons"))


TIMELINE = """, c as (select id as comment_id, session_id, created_us from comments),
tl as (
  select 'm' || lpad(cast(a.id as varchar), 19, '0') as key, 'moderator' as kind, a.comment_id, a.action, x.nickname as actor, s.nickname as author, a.created_us
  from actions a join c using (comment_id) join decisions d using (comment_id) join sessions s on s.id = c.session_id left join sessions x on x.id = a.session_id
  union all
  select 's' || cast(c.comment_id as varchar), 'system', c.comment_id, d.final_action, null, s.nickname, c.created_us
  from c join decisions d using (comment_id) join sessions s on s.id = c.session_id where d.final_action is distinct from 'clean')
"""


@query("panel_timeline_page", TIMELINE + f"select * from tl where (created_us, key) < ({DAY}, 's') order by created_us desc, key desc limit 51")
def timeline_page(t: Tables) -> DataFrame:
    rows = panel.timeline(t.actions, t.comments, t.sessions, t.decisions)
    return rows.filter(F.struct("created_us", "key") < F.struct(F.lit(DAY), F.lit("s"))).orderBy(F.desc("created_us"), F.desc("key")).limit(51)


@query("panel_timeline_moderator", TIMELINE + "select key, comment_id, action, actor, author from tl where kind = 'moderator'")
def timeline_moderator(t: Tables) -> DataFrame:
    return panel.timeline(t.actions, t.comments, t.sessions, t.decisions, "moderator").select("key", "comment_id", "action", "actor", "author")


@query("timeline_days", TIMELINE + f"select key, floor(created_us / {DAY_US})::bigint as day, dense_rank() over (order by floor(created_us / {DAY_US}) desc) as day_no from tl where kind = 'system'")
def timeline_days(t: Tables) -> DataFrame:
    rows = panel.timeline(t.actions, t.comments, t.sessions, t.decisions, "system").select("key", panel.bucket(F.col("created_us"), 0, DAY_US).alias("day"))
    days = rows.select("day").distinct()  # one row a day: small, so that the ranking needs no sort of all events
    return rows.join(days.withColumn("day_no", F.dense_rank().over(W.orderBy(F.desc("day"))).cast("long")), "day").select("key", "day", "day_no")


@query("item_previous_three", """select id, place, previous_id from (
  select id, unnest([1, 2, 3]) as place, unnest([lag(id, 1) over w, lag(id, 2) over w, lag(id, 3) over w]) as previous_id from comments window w as (partition by session_id order by created_us, id))
where previous_id is not null""")
def item_previous(t: Tables) -> DataFrame:
    return panel.previous(t.comments, 3)


@query("action_insert", """, ids as (select unnest([1, 2, 3, 99999999]) as comment_id)
select ids.comment_id, 'hide' as action, s.id as session_id from ids join comments c on c.id = ids.comment_id left join sessions s on s.id = 100000000""")
def action_insert(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([(1,), (2,), (3,), (99_999_999,)], "comment_id long")
    return panel.add_actions(ids, t.comments, t.sessions, "hide", 100_000_000, NOW_US)[0].drop("created_us")


@query("action_missing", "select distinct comment_id from actions where comment_id not in (select id from comments)")
def action_missing(t: Tables) -> DataFrame:
    return panel.add_actions(t.actions.select("comment_id"), t.comments, t.sessions, "hide", 0, NOW_US)[1].distinct()


@query("dashboard_counts", "select (select count(*) from comments) as comments, (select count(*) from sessions) as sessions, (select count(*) from decisions where final_action is distinct from 'clean') as flagged, (select count(*) from actions) as actions")
def dashboard(t: Tables) -> DataFrame:
    one = lambda d, n: d.agg(F.count("*").alias(n))
    out = one(t.comments, "comments")
    for d in (one(t.sessions, "sessions"), one(panel.flagged(t.decisions), "flagged"), one(t.actions, "actions")):
        out = out.crossJoin(d)  # single rows
    return out


@query("count_by_offense", "select offense_type, count(*) as n from scores where fired group by 1")
def count_by_offense(t: Tables) -> DataFrame:
    return t.scores.filter("fired").groupBy("offense_type").agg(F.count("*").alias("n"))


@query("count_by_verdict", "select coalesce(final_action, 'decision_failed') as verdict, count(*) as n from decisions group by 1")
def count_by_verdict(t: Tables) -> DataFrame:
    return t.decisions.groupBy(F.coalesce("final_action", F.lit("decision_failed")).alias("verdict")).agg(F.count("*").alias("n"))


@query("series_by_code", f"""select code, bucket, coalesce(n, 0) as n from (select unnest(['A1','A2','B1','B2','B4','C1']) as code) cross join (select unnest(range(7)) as bucket)
left join (select offense_type as code, floor((created_us - {WEEK}) / {DAY_US})::bigint as bucket, count(distinct comment_id) as n from scores where fired and created_us >= {WEEK} and created_us < {NOW_US} group by 1, 2) using (code, bucket)""")
def series_by_code(t: Tables) -> DataFrame:
    return panel.count_series(t.scores.filter("fired"), ["A1", "A2", "B1", "B2", "B4", "C1"], WEEK, DAY_US, 7)


@query("series_binary", f"select floor((created_us - {NOW_US - DAY_US}) / {HOUR_US})::bigint as bucket, count(*) as n from comments where binary_fired and created_us >= {NOW_US - DAY_US} and created_us < {NOW_US} group by 1")
def series_binary(t: Tables) -> DataFrame:
    start = NOW_US - DAY_US
    rows = t.comments.filter(F.coalesce("binary_fired", F.lit(False)) & (F.col("created_us") >= start) & (F.col("created_us") < NOW_US))
    return rows.groupBy(panel.bucket(F.col("created_us"), start, HOUR_US).alias("bucket")).agg(F.count("*").alias("n"))


@query("top_patterns", "select code, count(*) as n from (select unnest(codes) as code from patterns) group by 1 order by n desc, code limit 5")
def top_patterns(t: Tables) -> DataFrame:
    return t.patterns.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(5)


@query("active_devices", f"select count(distinct ip) as devices from comments c join sessions s on s.id = c.session_id where created_us > {NOW_US - 2 * DAY_US}")
def active_devices(t: Tables) -> DataFrame:
    rows = t.comments.filter(F.col("created_us") > NOW_US - 2 * DAY_US).join(t.sessions.withColumnRenamed("id", "session_id"), "session_id")
    return rows.agg(F.count_distinct("ip").alias("devices"))


RS = f"""select bucket, coalesce(requests, 0) as requests, coalesce(errors, 0) as errors, p50, p95 from (select unnest(range(30)) as bucket)
left join (select floor((created_us - {NOW_US - 30 * MINUTE_US * 30}) / {30 * MINUTE_US})::bigint as bucket, count(*) as requests, count_if(status_code >= 500) as errors,
  round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95 from metrics where created_us >= {NOW_US - 900 * MINUTE_US} and created_us < {NOW_US} group by 1) using (bucket)"""


@query("request_series", RS)
def request_series(t: Tables) -> DataFrame:
    got = panel.request_series(t.metrics, NOW_US - 900 * MINUTE_US, 30 * MINUTE_US, 30)
    return got.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query("request_rates", f"select round(count_if(created_us >= {NOW_US - 30 * MINUTE_US}) / 1800.0::double, 6) as per_second, case when count(*) > 0 then round(count_if(status_code >= 500) * 100.0::double / count(*), 2) end as error_pct from metrics where created_us >= {NOW_US - 900 * MINUTE_US} and created_us < {NOW_US}")
def request_rates(t: Tables) -> DataFrame:
    s = panel.request_series(t.metrics, NOW_US - 900 * MINUTE_US, 30 * MINUTE_US, 30)
    last = F.sum(F.when(F.col("bucket") == 29, F.col("requests")))
    return s.agg(F.round(last / 1800.0, 6).alias("per_second"), F.when(F.sum("requests") > 0, F.round(F.sum("errors") * 100.0 / F.sum("requests"), 2)).alias("error_pct"))


@query("status_share", "select status, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as pct from items group by status", ITEMS)
def status_share(t: Tables) -> DataFrame:
    got = items_of(t).groupBy("status").agg(F.count("*").alias("n"))
    return got.crossJoin(got.agg(F.sum("n").alias("total"))).select("status", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


@query("class_coverage", """select code, n from (select unnest(['A1','A2','A3','A4','B1','B2','B3','B4','B5','C1','C2','C3','C4','C5','D1']) as code) left join (select offense_type as code, count(*) as n from scores where fired group by 1) using (code)""")
def class_coverage(t: Tables) -> DataFrame:
    codes = t.spark.createDataFrame([(c,) for c in "A1 A2 A3 A4 B1 B2 B3 B4 B5 C1 C2 C3 C4 C5 D1".split()], "code string")
    return codes.join(count_by_offense(t).withColumnRenamed("offense_type", "code"), "code", "left")


@query("category_bars", "select offense_type as code, count(*) as n from scores where fired group by 1 having count(*) > 0 order by n desc")
def category_bars(t: Tables) -> DataFrame:
    return count_by_offense(t).withColumnRenamed("offense_type", "code").filter("n > 0").orderBy(F.desc("n"))


@query("session_exists", "select id from sessions where id in (select session_id from comments where from_cache) ")
def session_exists(t: Tables) -> DataFrame:
    return t.sessions.join(t.comments.filter("from_cache").select(F.col("session_id").alias("id")), "id", "left_semi").select("id")


@query("quality_violations", """select 'action_without_comment' as rule, count(*) as n from actions where comment_id not in (select id from comments)
union all select 'score_out_of_range', count(*) from scores where score < 0 or score > 1
union all select 'comment_without_session', count(*) from comments where session_id not in (select id from sessions)
union all select 'text_too_long', count(*) from comments where length(raw_text) > 5000 or trim(raw_text) = ''""")
def quality_violations(t: Tables) -> DataFrame:
    ids, own = t.comments.select(F.col("id").alias("comment_id")), t.sessions.select(F.col("id").alias("session_id"))
    rules = {
        "action_without_comment": t.actions.join(ids, "comment_id", "left_anti"), "score_out_of_range": t.scores.filter("score < 0 or score > 1"),
        "comment_without_session": t.comments.join(own, "session_id", "left_anti"), "text_too_long": t.comments.filter("length(raw_text) > 5000 or trim(raw_text) = ''"),
    }
    out = None
    for name, bad in rules.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("null_verdict_kept", "select final_action, count(*) as n from decisions where final_action is distinct from 'clean' group by 1")
def null_verdict_kept(t: Tables) -> DataFrame:
    return panel.flagged(t.decisions).groupBy("final_action").agg(F.count("*").alias("n"))


@query("moderation_word", "select comment_id, case when final_action is null then 'incomplete' when final_action = 'clean' then 'published' when final_action = 'block' then 'removed' when final_action = 'nudge' then 'warned' else 'in review' end as word from decisions")
def moderation_word(t: Tables) -> DataFrame:
    a = F.col("final_action")
    word = F.when(a.isNull(), "incomplete").when(a == "clean", "published").when(a == "block", "removed").when(a == "nudge", "warned").otherwise("in review")
    return t.decisions.select("comment_id", word.alias("word"))


@query("history_export", """select '"' || id || '","' || replace(raw_text, '"', '""') || '","' || coalesce(final_action, '') || '","' || array_to_string(fired_types, ' ') || '"' as line from items where detected""", ITEMS)
def history_export(t: Tables) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cols = [F.col("id").cast("string"), F.col("raw_text"), F.coalesce("final_action", F.lit("")), F.array_join("fired_types", " ")]
    return items_of(t).filter("detected").select(F.concat_ws(",", *(quoted(c) for c in cols)).alias("line"))


@query("thread_window", """select event_id, cast(case when user_id = k then 0 else coalesce(sum(case when offensive then 1 else 0 end) over (partition by user_id, k order by us range between 259199999999 preceding and current row), 0) end as bigint) as repeats
from (select *, event_type in ('error', 'click') as offensive from ev)""")
def thread_window(t: Tables) -> DataFrame:
    """Offensive posts of a sender to a target in the window up to each post; exactly as old as the window is out."""
    from moderix.streaming.repeats import repeats

    rows = t.ev.select("event_id", F.col("user_id").alias("sender"), F.col("k").alias("target"), F.col("us").alias("received_us"), F.col("event_type").isin("error", "click").alias("offensive"))
    return repeats(rows, 3 * DAY_US).select("event_id", "repeats")


@query("text_cache_key", "select id, 'artifact-1:' || sha256(raw_text) as cache_key from comments")
def text_cache_key(t: Tables) -> DataFrame:
    return t.comments.select("id", F.concat(F.lit("artifact-1:"), F.sha2(F.col("raw_text").cast("binary"), 256)).alias("cache_key"))


@query("result_cache_distinct", "select raw_text, count(*) as served, min(id) as scored_id from comments group by 1")
def result_cache(t: Tables) -> DataFrame:
    """Exact-text result reuse: each distinct text is scored once."""
    return t.comments.groupBy("raw_text").agg(F.count("*").alias("served"), F.min("id").alias("scored_id"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(Tables(spark, sf_dir))
