"""Queries of the text modules, the whole decision pipeline, generators, sinks and streaming replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.functions import charsafe, deobfuscate, lexicon_scan, target, text
from moderix.operators import decision as dec
from moderix.sources import readers, sinks
from moderix.plans.tables import DAY_US, MINUTE_US, NOW_US, Tables, book
from moderix.streaming import jobs

QUERIES, ORACLE_SQL, query = book()
LEXICON = lexicon_scan.lexicon_of([("idiot", "idiot", "B1"), ("moron", "moron", "B1"), ("scum", "scum", "A"), ("trash", "trash", "A"), ("loser", "loser", "B1")], ["trashcan"], {"trash": "can|bin"})


def posts(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")


@query("charsafe_posts", "select conv_id || '/' || turn as id, length(text)::int as n, len(regexp_extract_all(text, '[^\\s]*[Iİ][^\\s]*'))::int as patterns, true as ok from conversations")
def charsafe_posts(t: Tables) -> DataFrame:
    c = charsafe.charsafe(posts(t), "id")
    return c.select("id", F.length("charsafe_text").alias("n"), F.size("patterns").alias("patterns"), "ok")


@query("deobfuscated_posts")
def deobfuscated_posts(t: Tables) -> DataFrame:
    d = deobfuscate.deobfuscated(charsafe.charsafe(posts(t), "id", with_text=True), "id")
    return d.select("id", F.length("normalized_text").alias("n"), F.array_join(F.transform("patterns", lambda x: x["code"]), " ").alias("codes"), "ok")


#: Words of a post, lower-cased, without what follows an apostrophe; groups der and les, thing the.
TARGET_SQL = rf""", w as (
  select conv_id || '/' || turn as id, regexp_extract(unnest(regexp_extract_all(lower(translate(text, 'Iİ', 'ıi')), '[\pL\pN]+(?:[''’][\pL\pN]+)?')), '^[^''’]+') as w from conversations),
s as (
  select id, w, regexp_extract(w, '^(der|les)(?:{'|'.join(target.ENDS)})*$', 1) as g, regexp_extract(w, '^(the)(?:{'|'.join(target.ENDS)})*$', 1) as t from w),
k as (
  select id, w in ({", ".join(f"'{x}'" for x in (*target.SECOND, *target.CALLS))}) or (t = '' and regexp_full_match(w, '\pL{{4,}}(?:{'|'.join(target.VERB_ENDS)})')) as person,
    g <> '' and not regexp_matches(w[4:], '[aıoöuüâîû]|ki') as grp, t <> '' and not regexp_matches(w[4:], '[aıoöuüâîû]|ki') as thing from s),
m as (select conv_id || '/' || turn as id, len(regexp_extract_all(' ' || text, '[^\pL\pN_]@[\pL\pN_]{{2,}}')) as n from conversations),
n as (select id, sum(person::int) as p, sum(grp::int) as g, sum((thing and not grp)::int) as t from k group by 1)
"""


@query("target_posts", "select m.id, case when coalesce(p, 0) + m.n > 0 then 'individual' when g > 0 then 'group' when t > 0 then 'non_human' end as type, cast(least(8, coalesce(p + g + t, 0) + m.n) as int) as n from m left join n on n.id = m.id where true", TARGET_SQL)
def target_posts(t: Tables) -> DataFrame:
    r = target.resolved(posts(t), "id", groups=frozenset({"der", "les"}), things=frozenset({"the"}))
    return r.select("id", F.get("targets", 0)["type"].alias("type"), F.size("targets").alias("n"))


@query("doxing_scan")
def doxing_scan(t: Tables) -> DataFrame:
    r = target.resolved(t.raw("documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return r.select("id", F.explode("identifiers").alias("x")).select("id", "x.kind", "x.start", "x.end")


@query("email_counts", r"select count(*) as docs, cast(sum(len(e)) as bigint) as emails from (select regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+[A-Za-z0-9_]') as e from documents) where len(e) > 0")
def email_counts(t: Tables) -> DataFrame:
    e = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.+-]++@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+[A-Za-z0-9_]"), F.lit(0))
    return t.raw("documents").select(F.size(e).alias("n")).filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("emails"))


@query("moderation_pipeline")
def moderation_pipeline(t: Tables) -> DataFrame:
    """Texts to verdicts: all modules, then the decision layer."""
    rows = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    a = lexicon_scan.analysed(rows, LEXICON)
    d = dec.decided(a.withColumn("raw_score", F.lit(None).cast("double")).withColumn("degraded", F.size("failed") > 0))
    return d.select("id", "verdict.action", "verdict.driver", "offensive", "target_type", F.array_join(dec.active_form(dec.POLICY, F.col("form")), " ").alias("form"))


@query("channel_flips", f"""select count(*) as n, count(*) filter (dirty) as raw_dirty, count(*) filter (hidden and not dirty) as flipped from (
  select hidden, regexp_matches(lower(text), '(^|[^\\pL\\pN])(idiot|moron|scum|trash|loser)({"|".join(target.ENDS)})*($|[^\\pL\\pN])') as dirty
  from (select coalesce(text, '') as text, turn % 2 = 0 as hidden from conversations))""")
def channel_flips(t: Tables) -> DataFrame:
    """Posts that are clean as written and are not once the repaired channel is read as well: every other post hides a word."""
    rows = t.raw("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat(F.when(F.col("turn") % 2 == 0, "you s.c.u.m ").otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))
    dirty = lambda second: lexicon_scan.analysed(rows, LEXICON, second_channel=second).select("id", (F.size("content") > 0).alias("two" if second else "one"))
    both = dirty(False).join(dirty(True), "id")
    return both.agg(F.count("*").alias("n"), F.count_if("one").alias("raw_dirty"), F.count_if(F.col("two") & ~F.col("one")).alias("flipped"))


@query("score_validation", """, x as (select event_id, case when k % 10 = 0 then 1.5::double else k / 100 end as score, k as s0, k + 3 as e0, length(event_type) + 90 as n from ev)
select event_id, (score between 0 and 1 and e0 <= n) as valid from x""")
def score_validation(t: Tables) -> DataFrame:
    k = F.col("k")
    span = F.struct(k.cast("int").alias("start"), (k + 3).cast("int").alias("end"))
    s = dec.score(F.lit("A1"), F.when(k % 10 == 0, 1.5).otherwise(k / 100), F.lit("m1_lexicon@raw"), span, F.lit(None).cast("double"), F.lit(None).cast("boolean"))
    kept = dec.valid_scores(F.array(s), F.rpad("event_type", F.length("event_type") + 90, F.lit("x")))
    return t.ev.select("event_id", (F.size(kept) == 1).alias("valid"))


@query("stage_repairs", r"select event_id, regexp_replace(event_type, '(.)', '\1\1\1', 'g') as long, event_type as short from ev where event_type not in ('purchase', 'error')")
def stage_repairs(t: Tables) -> DataFrame:
    rows = t.ev.filter(~F.col("event_type").isin("purchase", "error")).withColumn("long", F.regexp_replace("event_type", "(.)", "$1$1$1"))
    return rows.select("event_id", "long", text.repeats_folded(F.col("long")).alias("short"))


@query("preview", r"select doc_id, case when length(x) <= 96 then x else rtrim(substr(x, 1, 95)) || '…' end as preview from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as x from documents)")
def preview(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("feed_generator")
def feed_generator(t: Tables) -> DataFrame:
    return readers.feed(t.spark, 40_000, 42, NOW_US - 14 * DAY_US)


@query("simulated_actions")
def simulated_actions(t: Tables) -> DataFrame:
    return readers.simulated_actions(feed_generator(t), NOW_US, 42)


@query("quarantine", "select case when broken = '' then 'valid' else broken end as broken, count(*) as n from (select concat_ws(' ', case when score < 0.9 is not true then 'high' end, case when offense_type <> 'B4' is not true then 'doxing' end) as broken from scores) group by 1")
def quarantine(t: Tables) -> DataFrame:
    good, bad = sinks.valid_and_bad(t.scores, {"high": F.col("score") < 0.9, "doxing": F.col("offense_type") != "B4"})
    rows = good.select(F.lit("valid").alias("broken")).unionByName(bad.select(F.array_join("broken", " ").alias("broken")))
    return rows.groupBy("broken").agg(F.count("*").alias("n"))


@query("fan_out_counts", "select unnest(['comments', 'scores', 'decisions']) as relation, unnest([n, 2 * n, n]) as n from (select count(*) as n from ev)")
def fan_out_counts(t: Tables) -> DataFrame:
    p = moderation_posts(t)
    parts = zip(("comments", "scores", "decisions"), sinks.fan_out(p), strict=True)
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def moderation_posts(t: Tables) -> DataFrame:
    from moderix.plans.decision_queries import posts as event_posts

    d = dec.decided(event_posts(t)).withColumnRenamed("event_id", "id")
    return d.withColumn("text", F.col("id").cast("string")).withColumn("created_us", F.lit(NOW_US))


@query("rows_digest", """select sha256(string_agg(d, '' order by p)) as sha256, cast(sum(n) as bigint) as n from (
  select substr(h, 1, 2) as p, sha256(string_agg(h, '' order by h)) as d, count(*) as n from (
    select sha256(concat('{"gold":', gold, ',"n_chars":', n_chars, ',"p":', p, ',"p2":', p2, ',"row_id":', row_id, ',"slice":"', slice, '"}')) as h from scored) group by 1)""")
def rows_digest(t: Tables) -> DataFrame:
    return sinks.rows_digest(t.scored, "row_id")


@query("csv_lines", """select '"' || row_id || '","' || slice || '"' || chr(13) as line from scored""")
def csv_lines(t: Tables) -> DataFrame:
    return sinks.csv_export(t.scored, ["row_id", "slice"])


@query("prediction_lines", "select row_id, printf('%.6f', p) as confidence from scored")
def prediction_lines(t: Tables) -> DataFrame:
    rows = t.scored.select("row_id", F.lit("").alias("text"), "gold", F.lit("").alias("pred"), F.col("p").alias("confidence"), "slice")
    return sinks.prediction_lines(rows).select("row_id", "confidence")


@query("rolling_percentile", f"""select endpoint, list_extract(l, greatest(1, floor(0.95::double * len(l) + 0.999999)::int)) as value, len(l) as n from (select endpoint, list(latency_ms order by latency_ms) as l from (select * from metrics where created_us > {NOW_US - 3 * DAY_US} and created_us <= {NOW_US} qualify row_number() over (partition by endpoint order by created_us desc, latency_ms) <= 50) group by 1)""")
def rolling_percentile(t: Tables) -> DataFrame:
    return jobs.last_percentile(t.metrics, 0.95, NOW_US, 50, 3 * DAY_US)


@query("rate_limited", """select id, allowed from r""", """, o as (
  select user_id as ip, event_id as id, us, row_number() over (partition by user_id order by us, event_id) as n from ev),
r as (
  select ip, id, us, n, 2.0::double as left_over, true as allowed from o where n = 1
  union all select ip, id, us, n, case when tokens >= 1 then tokens - 1 else tokens end, tokens >= 1
  from (select o.*, least(3.0::double, r.left_over + (o.us - r.us) / 1e6::double * 0.0002::double) as tokens from r join o on o.ip = r.ip and o.n = r.n + 1))
""")
def rate_limited(t: Tables) -> DataFrame:
    return jobs.rate_limited(t.ev.select(F.col("user_id").alias("ip"), F.col("event_id").alias("id"), F.col("us").alias("received_us")), 0.0002, 3)


@query("circuit_breaker", """select id, state, state <> 'open' as let from r""", f""", o as (
  select user_id as service, event_id as id, us, k % 3 <> 0 as ok, row_number() over (partition by user_id order by us, event_id) as n from ev),
r as (
  select service, id, us, n, 'closed' as state, 'closed' as after, case when ok then 0 else 1 end::bigint as run, 0::bigint as since from o where n = 1
  union all select service, id, us, n, state, case when state = 'open' then 'open' when ok then 'closed' when state = 'half_open' or run + 1 >= 2 then 'open' else state end,
    case when state = 'open' then run when ok then 0 when state = 'half_open' or run + 1 >= 2 then 0 else run + 1 end,
    case when state <> 'open' and not ok and (state = 'half_open' or run + 1 >= 2) then us else since end
  from (select o.*, case when r.after = 'open' and o.us - r.since >= {60 * MINUTE_US} then 'half_open' else r.after end as state, r.run, r.since from r join o on o.service = r.service and o.n = r.n + 1))
""")
def circuit_breaker(t: Tables) -> DataFrame:
    rows = t.ev.select(F.col("user_id").alias("service"), F.col("event_id").alias("id"), F.col("us").alias("at_us"), (F.col("k") % 3 != 0).alias("ok"))
    return jobs.breaker(rows, 2, 60 * MINUTE_US)


@query("cache_hits", "select count(*) as n, count(*) filter (hit) as hits from r", f""", o as (
  select user_id, k, us, row_number() over (partition by user_id, k order by us, event_id) as n from ev),
r as (
  select user_id, k, n, us as born, false as hit from o where n = 1
  union all select user_id, k, n, case when us - born < {60 * MINUTE_US} then born else us end, us - born < {60 * MINUTE_US} from (select o.*, r.born from r join o on o.user_id = r.user_id and o.k = r.k and o.n = r.n + 1))
""")
def cache_hits(t: Tables) -> DataFrame:
    """An hour's cache of 10 000 texts for each user."""
    rows = t.ev.select(F.col("user_id").alias("artifact"), F.col("event_id").alias("id"), F.col("k").cast("string").alias("key"), F.col("us").alias("at_us"), F.lit(True).alias("ok"))
    return jobs.cache_hits(rows, 10_000, 60 * MINUTE_US).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("queue_admission")
def queue_admission(t: Tables) -> DataFrame:
    rows = t.ev.select(F.col("event_type").alias("service"), F.col("event_id").alias("id"), F.col("us").alias("at_us"))
    return jobs.queued(rows, 4, 2, MINUTE_US, 1, 30 * MINUTE_US)


@query("writer_flushes")
def writer_flushes(t: Tables) -> DataFrame:
    kind = F.when(F.col("k") % 3 == 0, "analysis").otherwise("metric")
    rows = t.ev.select(F.col("user_id").alias("writer"), F.col("event_id").alias("id"), kind.alias("kind"), F.col("us").alias("at_us"))
    return jobs.buffered(rows, 3, 5, 600 * MINUTE_US)


@query("polled_aggregates", f"select event_id as id, row_number() over (partition by event_type, us // {MINUTE_US} order by us, event_id) = 1 as fresh from ev")
def polled_aggregates(t: Tables) -> DataFrame:
    return jobs.polled(t.ev.select(F.col("event_type").alias("name"), F.col("event_id").alias("id"), F.col("us").alias("at_us")), MINUTE_US)


@query("metrics_windows", f"select floor(created_us / {5 * MINUTE_US})::bigint as w, count(*) as n from metrics group by 1")
def metrics_windows(t: Tables) -> DataFrame:
    ts = F.timestamp_micros("created_us")
    g = t.metrics.groupBy(F.window(ts, "5 minutes")).agg(F.count("*").alias("n"))
    return g.select((F.unix_micros("window.start") / (5 * MINUTE_US)).cast("long").alias("w"), "n")
