"""Queries on records, states, traps, diffs, gates, samples and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.functions import charsafe, deobfuscate
from moderix.operators import records as rec
from moderix.plans.tables import VERDICTS, Tables, book

QUERIES, ORACLE_SQL, query = book()


def result_json(t: Tables) -> DataFrame:
    k = F.col("k")
    verdict = F.when(k % 6 == 5, "ban").otherwise(F.element_at(F.array(*(F.lit(v) for v in VERDICTS)), (F.least(k % 6, F.lit(4)) + 1).cast("int")))
    content = F.array(F.struct(F.lit("B1").alias("code"), (k / 100).alias("score"), F.lit("m1_lexicon@raw").alias("source"), (k >= 50).alias("fired")), F.struct(F.lit("A1").alias("code"), F.lit(0.7).alias("score"), F.lit("m1_lexicon@raw").alias("source"), (k % 2 == 0).alias("fired")))
    signals = F.when(k % 5 != 0, F.struct(F.struct(F.when(k % 13 == 0, F.array(F.lit("m3_encoder"))).otherwise(F.array().cast("array<string>")).alias("degraded")).alias("pipeline")))
    return t.ev.select("event_id", F.to_json(F.struct(verdict.alias("verdict"), content.alias("content"), signals.alias("signals"))).alias("result"))


@query("record_summary", """select event_id, k % 6 <> 5 as valid, case k % 6 when 0 then 'clean' when 1 then 'nudge' when 2 then 'review' when 3 then 'escalate' when 4 then 'block' end as verdict,
  concat_ws(' ', case when k >= 50 then 'B1' end, case when k % 2 = 0 then 'A1' end) as fired, k % 5 = 0 or k % 13 = 0 as degraded from ev""")
def record_summary(t: Tables) -> DataFrame:
    s = result_json(t).select("event_id", rec.summary(F.col("result"), list(VERDICTS)).alias("s"))
    return s.select("event_id", "s.valid", "s.verdict", F.array_join("s.fired_types", " ").alias("fired"), "s.degraded")


@query("record_variant", "select event_id, 'B1' as first_code, k / 100 as first_score from ev")
def record_variant(t: Tables) -> DataFrame:
    """The same record as a semi-structured value."""
    v = F.parse_json("result")
    return result_json(t).select("event_id", F.variant_get(v, "$.content[0].code", "string").alias("first_code"), F.variant_get(v, "$.content[0].score", "double").alias("first_score"))


@query("fired_categories", "select event_id, case when k > 70 and k % 2 = 0 then 'B1 A1' when k >= 50 and k % 2 = 0 then case when k / 100 = 0.7 then 'A1 B1' else 'A1 B1' end when k >= 50 then 'B1' when k % 2 = 0 then 'A1' else '' end || case when k % 7 = 0 then case when k >= 50 or k % 2 = 0 then ' binary_offensive' else 'binary_offensive' end else '' end as codes from ev")
def fired_categories(t: Tables) -> DataFrame:
    k = F.col("k")
    content = F.array(F.struct(F.lit("B1").alias("code"), (k / 100).alias("score"), (k >= 50).alias("fired")), F.struct(F.lit("A1").alias("code"), F.lit(0.7).alias("score"), (k % 2 == 0).alias("fired")))
    return t.ev.select("event_id", F.array_join(rec.fired_categories(content, k % 7 == 0), " ").alias("codes"))


@query("module_states", "select event_id, case when k % 4 = 0 then 'failed' when k % 4 = 1 then 'stub' when k % 4 = 2 then 'ran' else 'absent' end as state from ev")
def module_states(t: Tables) -> DataFrame:
    k, none = F.col("k"), F.array().cast("array<string>")
    m = F.array(F.lit("m3_encoder"))
    times = F.when(k % 4 < 3, F.create_map(F.lit("m3_encoder"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    return t.ev.select("event_id", rec.module_state(times, F.when(k % 4 == 0, m).otherwise(none), F.when(k % 4 == 1, m).otherwise(none), "m3_encoder").alias("state"))


@query("public_signals", "select event_id, concat_ws(' ', case when k % 2 = 0 then 'changed' end, 'tier_' || k % 3, case when k % 5 = 0 then 'z' end) as keys from ev")
def public_signals(t: Tables) -> DataFrame:
    k = F.col("k")
    names = F.filter(F.array(F.when(k % 2 == 0, "changed"), F.when(k % 3 == 0, "_offsets"), F.concat(F.lit("tier_"), (k % 3).cast("string")), F.concat(F.lit("_k"), k.cast("string")), F.when(k % 5 == 0, "z")), lambda x: x.isNotNull())
    m = F.map_from_arrays(names, F.transform(names, lambda x: F.length(x).cast("string")))
    return t.ev.select("event_id", F.array_join(F.array_sort(F.map_keys(rec.public(m))), " ").alias("keys"))


@query("trap_problems", "select comment_id as id, 'missing' as problem, 'LEET' as code from patterns where not list_contains(codes, 'LEET') union all select comment_id, 'forbidden', 'REPEAT' from patterns where list_contains(codes, 'REPEAT')")
def trap_problems(t: Tables) -> DataFrame:
    return rec.trap_problems(t.patterns.select(F.col("comment_id").alias("id"), "codes", F.array(F.lit("LEET")).alias("must"), F.array(F.lit("REPEAT")).alias("must_not")))


@query("scenario_checks", "select comment_id, len(codes) = 1 and codes[1] = 'LEET' as exact, list_contains(codes, 'LEET') as include, list_contains(codes, 'LEET') or list_contains(codes, 'SPACED') as some, not list_contains(codes, 'SPACED') as exclude from patterns")
def scenario_checks(t: Tables) -> DataFrame:
    one, two, three = F.array(F.lit("LEET")), F.array(F.lit("LEET"), F.lit("SPACED")), F.array(F.lit("SPACED"))
    c = F.col("codes")
    return t.patterns.select("comment_id", rec.expectation("exact", c, one).alias("exact"), rec.expectation("include", c, one).alias("include"), rec.expectation("any", c, two).alias("some"), rec.expectation("exclude", c, three).alias("exclude"))


@query("selective_routing", "select row_id, case when c >= 0.7 then 'AUTO-RESOLVE' else 'DEFER' end as route, case when c >= 0.7 then p end as score from (select *, case when p > 0.5 then p else 1 - p end as c from scored)")
def selective_routing(t: Tables) -> DataFrame:
    p = F.col("p")
    return t.scored.select("row_id", rec.routed(F.when(p > 0.5, p).otherwise(1 - p), 0.7, p).alias("r")).select("row_id", "r.*")


@query("label_flips", "select row_id, was, now, case when row_id % 4 = 0 then 'R2' else '' end as came, 'R1' as went from (select row_id, gold as was, case when row_id % 3 = 0 then 1 - gold else gold end as now from scored) where was <> now")
def label_flips(t: Tables) -> DataFrame:
    old = t.scored.select("row_id", F.col("gold").alias("label"), F.array(F.lit("R1")).alias("rules"))
    new = t.scored.select("row_id", F.when(F.col("row_id") % 3 == 0, 1 - F.col("gold")).otherwise(F.col("gold")).alias("label"), F.when(F.col("row_id") % 4 == 0, F.array(F.lit("R2"))).otherwise(F.array().cast("array<string>")).alias("rules"))
    return rec.label_flips(old, new)


@query("pseudo_labels", "select row_id, case when row_id % 2 = 0 and row_id % 3 = 0 then 1 when row_id % 2 <> 0 then 0 end as label from scored")
def pseudo_labels(t: Tables) -> DataFrame:
    return t.scored.select("row_id", rec.pseudo_label(F.col("row_id") % 2 == 0, F.col("row_id") % 3 == 0).alias("label"))


@query("figure_gate", "select * from (select 'positive' as figure, (select count(*) from labels where toxic = 1)::double + 1 as expected, count(*) filter (gold = 1)::double as observed from scored) where expected <> observed")
def figure_gate(t: Tables) -> DataFrame:
    """Figures of the scored rows against those of the labels that they come from; the one that is off by one shows."""
    want = t.raw("labels").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("positive")).first()
    got = t.scored.agg(F.count("*").alias("n"), F.count_if(F.col("gold") == 1).alias("positive"))
    return rec.gate(got, {"n": want.n, "positive": want.positive + 1})


@query("partition_faults", "select row_id, case when row_id % 10 = 0 then 'overlap' else 'missing' end as fault from scored where row_id % 10 = 0 or row_id % 10 = 9")
def partition_faults(t: Tables) -> DataFrame:
    m = F.col("row_id") % 10
    return rec.partition_faults({"a": t.scored.filter(m <= 4), "b": t.scored.filter(((m > 4) & (m < 9)) | (m == 0))}, t.scored, "row_id")


@query("span_segments", "select event_id, case when k % 2 = 0 then '0-2: 2-5:a 5-6:ab 6-9:b 9-20:' else '0-1: 1-4:a 4-6: 6-9:b 9-20:' end as segments from ev")
def span_segments(t: Tables) -> DataFrame:
    even = F.col("k") % 2 == 0
    span = lambda a, z, k: F.struct(a.alias("start"), z.alias("end"), F.lit(k).alias("key"))
    spans = F.array(span(F.when(even, 2).otherwise(1), F.when(even, 6).otherwise(4), "a"), span(F.when(even, 5).otherwise(6), F.lit(9), "b"))
    s = rec.segments(F.rpad("event_type", 20, F.lit("x")), spans)
    said = F.array_join(F.transform(s, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(":"), F.array_join(x["keys"], ""))), " ")
    return t.ev.select("event_id", said.alias("segments"))


@query("normalization_changes")
def normalization_changes(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat(F.lit("s a l a k "), "text").alias("text"))
    d = deobfuscate.deobfuscated(charsafe.charsafe(rows, "id", with_text=True), "id")
    return d.select("id", F.explode(rec.changes(F.col("patterns"), F.col("offsets"))).alias("x")).select("id", "x.*")


@query("damage_rate", "select count(*) as n, count_if(event_type in ('error', 'click')) as damaged from ev")
def damage_rate(t: Tables) -> DataFrame:
    after = F.when(F.col("event_type").isin("error", "click"), F.concat("event_type", F.lit("x"))).otherwise(F.upper("event_type"))
    return t.ev.agg(F.count("*").alias("n"), F.count_if(rec.damaged(F.lower("event_type"), F.translate(after, "I", "İ"))).alias("damaged"))


@query("capabilities", """select code, module, threshold, case when module is null then 'not_produced' when module in (select 'm4_implicit' from decisions where degraded) then 'degraded' else 'active' end as state
from (select offense_type as code, case when offense_type in ('A1', 'A2') then 'm1_lexicon' when offense_type = 'B4' then 'm6_target' when offense_type = 'B1' then 'm4_implicit' end as module, round(min(score), 6) as threshold from scores group by 1)""")
def capabilities(t: Tables) -> DataFrame:
    """The codes that the scores hold, with the least score seen as threshold; a module is degraded if a decision says so."""
    code = F.col("offense_type")
    module = F.when(code.isin("A1", "A2"), "m1_lexicon").when(code == "B4", "m6_target").when(code == "B1", "m4_implicit")
    codes = t.scores.select(code.alias("code"), module.alias("module")).distinct()
    thresholds = t.scores.groupBy(code.alias("code")).agg(F.round(F.min("score"), 6).alias("threshold"))
    return rec.capability(codes, thresholds, [] if t.decisions.filter("degraded").isEmpty() else ["m4_implicit"])


@query("matched_outcomes", "select user_id as id, row_number() over (partition by user_id order by event_id) as n, event_id as place, event_id as answer_place from ev")
def matched_outcomes(t: Tables) -> DataFrame:
    a = t.ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("place"))
    return rec.matched_outcomes(a, a).select("id", F.col("n").cast("long").alias("n"), "place", "answer_place")


@query("random_sample", "select row_id, gold from scored order by md5(row_id || '|42'), row_id limit 100")
def random_sample(t: Tables) -> DataFrame:
    return rec.random_sample(t.scored.select("row_id", "gold"), 100, 42, "row_id")


@query("out_of_fold", "select row_id, cast(row_id % 3 as int) as fold from scored")
def out_of_fold(t: Tables) -> DataFrame:
    part = lambda k: t.scored.filter(F.col("row_id") % 3 == k).select("row_id", F.lit(k).alias("fold"))
    return rec.out_of_fold([part(0), part(1), part(2)], t.scored)


@query("disguised_words")
def disguised_words(t: Tables) -> DataFrame:
    return t.ev.select("event_id", rec.disguised(F.col("event_type"), F.col("event_id"), 42).alias("d")).select("event_id", "d.*")


@query("augmented_rows")
def augmented_rows(t: Tables) -> DataFrame:
    rows = t.raw("documents").join(t.raw("labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.col("toxic").alias("label"))
    return rec.augmented(rows, F.array(*(F.lit(w) for w in ("idiot", "moron", "scum"))), "[MASK]", 42)
