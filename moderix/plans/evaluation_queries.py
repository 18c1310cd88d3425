"""Queries of the evaluation operators over the scored rows of ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderix.functions import text
from moderix.operators import evaluation as ev
from moderix.plans.tables import Tables, book

QUERIES, ORACLE_SQL, query = book()
T = 0.320188
DEC = 6


def P() -> Column:  # noqa: N802
    return F.col("p")


def GOLD() -> Column:  # noqa: N802
    return F.col("gold")


def rounded(df: DataFrame, places: int = DEC) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


CELLS = f""", c as (
  select coalesce(slice, 'all') as slice, count_if(gold = 0 and p < {T}) as tn, count_if(gold = 0 and p >= {T}) as fp, count_if(gold = 1 and p < {T}) as fn, count_if(gold = 1 and p >= {T}) as tp
  from scored group by grouping sets ((slice), ()))
"""


@query("confusion_by_slice", "select * from c", CELLS)
def confusion(t: Tables) -> DataFrame:
    return ev.by_slice(t.scored, P() >= T)


@query("metrics_by_slice", """select slice, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round((coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::double * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) as macro_f1,
  round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) as accuracy, round(fp / nullif(fp + tn, 0), 6) as fpr from c""", CELLS)
def metrics(t: Tables) -> DataFrame:
    return rounded(ev.by_slice(t.scored, P() >= T).select("slice", *ev.metrics()))


@query("recall_gap", "select round(max(case when slice = 'hit' then tp / nullif(tp + fn, 0) end) - max(case when slice = 'free' then tp / nullif(tp + fn, 0) end), 6) as gap from c", CELLS)
def recall_gap(t: Tables) -> DataFrame:
    m = ev.by_slice(t.scored, P() >= T).select("slice", *ev.metrics())
    of = lambda s: F.max(F.when(F.col("slice") == s, F.col("recall")))
    return m.agg(F.round(of("hit") - of("free"), DEC).alias("gap"))


@query("cell_cube", f"""select coalesce(slice, 'any') as slice, coalesce(cast(gold as varchar), 'any') as gold, coalesce(band, 'any') as band, count(*) as n from
(select *, case when p < 0.25 then 'low' when p < 0.5 then 'mid' else 'high' end as band from scored) group by cube (slice, gold, band)""")
def cell_cube(t: Tables) -> DataFrame:
    band = F.when(P() < 0.25, "low").when(P() < 0.5, "mid").otherwise("high")
    g = t.scored.withColumn("band", band).withColumn("gold", GOLD().cast("string")).cube("slice", "gold", "band").agg(F.count("*").alias("n"))
    return g.fillna("any", ["slice", "gold", "band"])


AUC = """select {keys} round(sum(case when a.p > b.p then 1.0::double when a.p = b.p then {tie}::double else 0 end) / count(*), 6) as auc from scored a join scored b on a.gold = 1 and b.gold = 0 {on} {group}"""


@query("auc_by_slice", AUC.format(keys="a.slice,", tie=0.5, on="and a.slice = b.slice", group="group by a.slice"))
def auc_by_slice(t: Tables) -> DataFrame:
    return rounded(ev.auc(t.scored, "p", ("slice",)).select("slice", "auc"))


@query("auc_tie_bounds", f"select x.auc as auc_low, y.auc as auc_high from ({AUC.format(keys='', tie=0.0, on='', group='')}) x, ({AUC.format(keys='', tie=1.0, on='', group='')}) y")
def auc_tie_bounds(t: Tables) -> DataFrame:
    low, high = (ev.auc(t.scored, "p", (), c).select(F.round("auc", DEC).alias(n)) for c, n in ((0.0, "auc_low"), (1.0, "auc_high")))
    return low.crossJoin(high)


@query("average_precision", "select slice, round(sum(pos * tp / n) / sum(pos), 6) as ap from (select slice, pos, sum(pos) over w as tp, sum(k) over w as n from (select slice, p, count_if(gold = 1) as pos, count(*) as k from scored group by 1, 2) window w as (partition by slice order by p desc)) group by slice")
def average_precision(t: Tables) -> DataFrame:
    return rounded(ev.average_precision(t.scored, "p", ("slice",)))


CURVE = """, u as (select distinct slice, p as t from scored union select slice, min(p) - 1e-6 from scored group by slice),
curve as (
  select u.slice, u.t, count_if(s.gold = 0 and s.p <= u.t) as tn, count_if(s.gold = 0 and s.p > u.t) as fp, count_if(s.gold = 1 and s.p <= u.t) as fn, count_if(s.gold = 1 and s.p > u.t) as tp
  from u join scored s using (slice) group by 1, 2),
priced as (select *, (fn * 3.0::double + fp) / (tn + fp + fn + tp) as cost from curve)
"""


@query("cost_curve", "select slice, round(t, 6) as t, tn, fp, fn, tp, round(cost, 6) as cost from priced", CURVE)
def cost_curve(t: Tables) -> DataFrame:
    c = rounded(ev.threshold_curve(t.scored, "p", 3.0, ("slice",)).drop("flags"))
    return c.select("slice", "t", *(F.col(x).cast("long").alias(x) for x in ("tn", "fp", "fn", "tp")), "cost")


@query("cost_curve_fit", "select slice, round(t, 6) as t, round(cost, 6) as cost, tp, fp, fn, tn from priced qualify row_number() over (partition by slice order by cost, t) = 1", CURVE)
def cost_curve_fit(t: Tables) -> DataFrame:
    c = ev.fit_threshold(ev.threshold_curve(t.scored, "p", 3.0, ("slice",)), ("slice",))
    return rounded(c)


@query("pair_fit_capped", """select t_a, t_b, flags, cost from (select round(a.t, 6) as t_a, round(b.t, 6) as t_b, a.tp + a.fp + b.tp + b.fp as flags, a.fn * 3.0::double + a.fp + b.fn * 3.0::double + b.fp as cost, a.t as ta, b.t as tb
  from curve a join curve b on a.slice = 'hit' and b.slice = 'free' where a.tp + a.fp + b.tp + b.fp <= 120) order by flags desc, cost, ta, tb limit 1""", CURVE)
def pair_fit(t: Tables) -> DataFrame:
    c = ev.threshold_curve(t.scored, "p", 3.0, ("slice",))
    return rounded(ev.fit_pair(c.filter("slice = 'hit'"), c.filter("slice = 'free'"), 120)).withColumn("flags", F.col("flags").cast("long"))


@query("matched_precision", "select slice, round(min(t), 6) as t from priced where tp + fp > 0 and tp / (tp + fp) >= 0.6 group by slice", CURVE)
def matched_precision(t: Tables) -> DataFrame:
    c = ev.threshold_curve(t.scored, "p", 3.0, ("slice",)).filter("flags > 0 and tp / flags >= 0.6")
    return rounded(c.groupBy("slice").agg(F.min("t").alias("t")))


@query("matched_flag_rate", "select slice, round(t, 6) as t, tp + fp as flags from priced qualify row_number() over (partition by slice order by abs((tp + fp) / (tn + fp + fn + tp) - 0.2), t) = 1", CURVE)
def matched_flags(t: Tables) -> DataFrame:
    c = ev.threshold_curve(t.scored, "p", 3.0, ("slice",))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    best = F.min_by(F.struct("t", "flags"), F.struct(F.abs(F.col("flags") / n - 0.2), F.col("t")))
    return rounded(c.groupBy("slice").agg(best.alias("b")).select("slice", "b.t", "b.flags"))


@query("cost_ratio_grid", """select round(r, 2) as r, round(t, 6) as t, round(cost, 6) as cost from (select g.r, c.t, (c.fn * g.r + c.fp) / (c.tn + c.fp + c.fn + c.tp) as cost from curve c, (select unnest(range(1, 41)) * 0.25::double as r) g where c.slice = 'hit')
qualify row_number() over (partition by r order by cost, t) = 1""", CURVE)
def cost_ratio_grid(t: Tables) -> DataFrame:
    c = ev.threshold_curve(t.scored.filter("slice = 'hit'"), "p", 3.0)
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i * 0.25)).alias("r")
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    cost = (F.col("fn") * F.col("r") + F.col("fp")) / n
    best = F.min_by(F.struct("t", "cost"), F.struct("cost", "t"))
    return rounded(c.select("*", grid).withColumn("cost", cost).groupBy(F.round("r", 2).alias("r")).agg(best.alias("b")).select("r", "b.*"))


CONF = "case when p > 0.5 then p else 1 - p end"


@query("reliability_bins", f"""select bin, coalesce(n, 0) as n, confidence, accuracy from (select unnest(range(15)) as bin) left join (
  select least(floor(({CONF} - 0.5::double) / (0.5::double / 15)), 14)::bigint as bin, count(*) as n, round(avg({CONF}), 6) as confidence, round(avg(((p > 0.5)::int = gold)::int), 6) as accuracy from scored group by 1) using (bin)""")
def reliability_bins(t: Tables) -> DataFrame:
    conf = F.when(P() > 0.5, P()).otherwise(1 - P())
    return rounded(ev.reliability(t.scored, conf, (P() > 0.5).cast("int") == GOLD(), 0.5, 1.0, 15))


BINS = ", b as (select least(floor(p / 0.1::double), 9)::bigint as bin, count(*) as n, avg(p) as confidence, avg(gold) as accuracy from scored group by 1)"


@query("reliability_table", "select bin, coalesce(n, 0) as n, round(confidence, 6) as confidence, round(accuracy, 6) as accuracy from (select unnest(range(10)) as bin) left join b using (bin)", BINS)
def reliability_table(t: Tables) -> DataFrame:
    return rounded(ev.reliability(t.scored, P(), GOLD() == 1, 0.0, 1.0, 10))


@query("calibration_error", "select round(sum(n * abs(accuracy - confidence)) / sum(n), 6) as ece, round(max(abs(accuracy - confidence)), 6) as mce, round(sum(n * (accuracy - confidence)) / sum(n), 6) as signed from b", BINS)
def calibration_error(t: Tables) -> DataFrame:
    return rounded(ev.calibration_error(ev.reliability(t.scored, P(), GOLD() == 1, 0.0, 1.0, 10)))


@query("nll_grid", """select temperature, round(avg(-case when gold = 1 then ln(q) else ln(1 - q) end), 6) as nll from (select gold, temperature, least(greatest(1 / (1 + exp(-ln(c / (1 - c)) / temperature)), 1e-6), 1 - 1e-6) as q
  from (select gold, least(greatest(p, 1e-6::double), 1 - 1e-6::double) as c from scored), (select unnest([0.5::double, 1.0, 1.5, 2.0, 4.0]) as temperature)) group by 1""")
def nll_grid(t: Tables) -> DataFrame:
    return rounded(ev.nll(t.scored, "p", [0.5, 1.0, 1.5, 2.0, 4.0]))


def _fit_sql(rounds: int = 3, points: int = 41) -> str:
    """The grids of the temperature fit, one behind the other."""
    out = ", lim0 as (select ln(0.05::double) as a, ln(20.0::double) as b)"
    for k in range(rounds):
        out += f""", grid{k} as (select i, a + (b - a) * i / {points - 1} as g from lim{k}, (select unnest(range({points})) as i)),
loss{k} as (select i, avg(-case when gold = 1 then ln(q) else ln(1 - q) end) as l from (
  select i, gold, least(greatest(1 / (1 + exp(-ln(c / (1 - c)) / exp(g))), 1e-6), 1 - 1e-6) as q from (select gold, least(greatest(p, 1e-6::double), 1 - 1e-6::double) as c from scored), grid{k}) group by i),
best{k} as (select i from loss{k} order by l, i limit 1),
lim{k + 1} as (select (select g from grid{k} where grid{k}.i = greatest(0, best{k}.i - 1)) as a, (select g from grid{k} where grid{k}.i = least({points - 1}, best{k}.i + 1)) as b from best{k})"""
    return out + " "


@query("temperature_fit", "select round(exp((a + b) / 2), 4) as temperature, (select i in (0, 40) from best0) as at_boundary from lim3", _fit_sql())
def temperature_fit(t: Tables) -> DataFrame:
    best, edge = ev.fit_temperature(t.scored)
    return t.spark.createDataFrame([(round(best, 4), edge)], "temperature double, at_boundary boolean")


@query("risk_coverage", f"""select coverage, k, round(1 - avg(ok), 6) as risk from (select coverage, k, ok, rn from (select *, greatest(1, round_even(coverage * n, 0))::bigint as k from (select unnest([0.1::double, 0.25, 0.5, 0.75, 0.9, 1.0]) as coverage), (select count(*) as n from scored)),
  (select ((p > 0.5)::int = gold)::int as ok, row_number() over (order by {CONF} desc, row_id) as rn from scored)) where rn <= k group by 1, 2""")
def risk_coverage(t: Tables) -> DataFrame:
    conf = F.when(P() > 0.5, P()).otherwise(1 - P())
    return rounded(ev.risk_coverage(t.scored, conf, (P() > 0.5).cast("int") == GOLD(), [0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))


@query("risk_coverage_invariance", """select coverage, k, round(1 - sum(ok) filter (r <= k) / k, 6) as risk, round(1 - sum(ok) filter (r <= k) / k, 6) as tempered_risk
from (select *, greatest(1, round_even(coverage * n, 0))::bigint as k from (select *, row_number() over (partition by coverage order by c desc, row_id) as r from (
  select row_id, greatest(p, 1 - p) as c, (case when p >= 0.5 then 1 else 0 end = gold)::int as ok, count(*) over () as n from scored), (select unnest([0.5::double, 0.8, 1.0]) as coverage))) group by coverage, k""")
def risk_coverage_invariance(t: Tables) -> DataFrame:
    """A temperature changes no order, so risk and coverage stay: rounded confidences tie alike on both sides."""
    right = (P() >= 0.5).cast("int") == GOLD()
    sure = F.greatest(P(), 1 - P())
    plain = ev.risk_coverage(t.scored, sure, right, [0.5, 0.8, 1.0])
    warm = ev.risk_coverage(t.scored, F.round(ev.tempered(sure, 1.7), 9), right, [0.5, 0.8, 1.0]).withColumnRenamed("risk", "tempered_risk")
    return rounded(plain.join(warm, ["coverage", "k"]))


@query("operating_point", f"""select slice, n, deferred, round(deferred / n, 6) as deferral, round(captured / nullif(errors, 0), 6) as capture, round(captured / nullif(errors, 0) / nullif(deferred / n, 0), 6) as lift, round(auto_errors / nullif(n - deferred, 0), 6) as auto_risk from (
  select coalesce(slice, 'all') as slice, count(*) as n, count_if({CONF} < 0.7) as deferred, count_if((p > 0.5)::int <> gold) as errors, count_if((p > 0.5)::int <> gold and {CONF} < 0.7) as captured, count_if((p > 0.5)::int <> gold and {CONF} >= 0.7) as auto_errors
  from scored group by grouping sets ((slice), ()))""")
def operating_point(t: Tables) -> DataFrame:
    return rounded(ev.operating_point(t.scored, F.when(P() > 0.5, P()).otherwise(1 - P()), P() > 0.5, 0.7))


@query("score_distribution", "select gold, round(avg(p), 6) as mean, round(quantile_cont(p, 0.25), 6) as q1, round(quantile_cont(p, 0.5), 6) as median, round(quantile_cont(p, 0.75), 6) as q3, round(avg((p <= 0.5)::int), 6) as low_share from scored group by gold")
def score_distribution(t: Tables) -> DataFrame:
    q = F.percentile("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = t.scored.groupBy("gold").agg(F.avg("p").alias("mean"), q.alias("q"), F.avg((P() <= 0.5).cast("double")).alias("low_share"))
    return rounded(g.select("gold", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low_share"))


@query("crossings", "select count_if(p < 0.4 and p2 >= 0.4) as up, count_if(p >= 0.4 and p2 < 0.4) as down, count_if(p < 0.4 and p2 >= 0.4) - count_if(p >= 0.4 and p2 < 0.4) as net from scored")
def crossings(t: Tables) -> DataFrame:
    return ev.crossings(t.scored, "p", "p2", 0.4)


@query("disagreement", "select (p >= 0.4) as a, (p2 >= 0.4) as b, count(*) as n, count_if(gold = 1) as positive from scored group by 1, 2")
def disagreement(t: Tables) -> DataFrame:
    return t.scored.groupBy((P() >= 0.4).alias("a"), (F.col("p2") >= 0.4).alias("b")).agg(F.count("*").alias("n"), F.count_if(GOLD() == 1).alias("positive"))


@query("kappa", """select n, round(same / n * 100, 6) as agreement_pct, round((same / n - e) / nullif(1 - e, 0), 6) as kappa from (select *, (a1 * b1 + (n - a1) * (n - b1)) / (n * n)::double as e from (
  select count(*) as n, count_if((p >= 0.4) = (p2 >= 0.4)) as same, count_if(p >= 0.4) as a1, count_if(p2 >= 0.4) as b1 from scored))""")
def kappa(t: Tables) -> DataFrame:
    return rounded(ev.kappa(t.scored, (P() >= 0.4).cast("int"), (F.col("p2") >= 0.4).cast("int")))


@query("aligned_dumps", """select coalesce(a.row_id, b.row_id) as row_id, case when b.row_id is null then 'only_a' when a.row_id is null then 'only_b' else 'differs' end as problem
from (select * from scored where row_id % 7 <> 0) a full join (select row_id, case when row_id % 11 = 0 then 1 - gold else gold end as gold, slice from scored where row_id % 5 <> 0) b on a.row_id = b.row_id
where a.row_id is null or b.row_id is null or a.gold is distinct from b.gold or a.slice is distinct from b.slice""")
def aligned(t: Tables) -> DataFrame:
    a = t.scored.filter("row_id % 7 <> 0")
    b = t.scored.filter("row_id % 5 <> 0").withColumn("gold", F.when(F.col("row_id") % 11 == 0, 1 - GOLD()).otherwise(GOLD()))
    return ev.aligned(a, b, ["gold", "slice"])


TOKENS = """, words as (select d.doc_id as row_id, cast(l.toxic as int) as gold, unnest(regexp_extract_all(lower(translate(d.text, 'Iİ', 'ıi')), '[\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]+')) as token from documents d join labels l using (doc_id)),
tot as (select count(*) as n, sum(toxic) as n1 from labels join documents using (doc_id)),
tok as (select token, count(*) as df, cast(sum(gold) as bigint) as df1, cast(sum(k) as bigint) as occurrences from (select row_id, gold, token, count(*) as k from words group by 1, 2, 3) group by 1)
"""


def token_rows(t: Tables) -> DataFrame:
    d = t.raw("documents").select(F.col("doc_id").alias("row_id"), "text").join(t.raw("labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").cast("int").alias("gold")), "row_id")
    return ev.token_table(d.select("row_id", "gold", text.tokens(F.col("text")).alias("tokens")))


@query("token_df_z", "select token, df, df1, occurrences, round((df1 / df) / (n1 / n), 6) as lift, round((df1 - df * (n1 / n)) / sqrt(df * (n1 / n) * (1 - n1 / n)), 6) as z, round(df1 - df * (n1 / n), 6) as excess from tok, tot where df >= 5", TOKENS)
def token_df_z(t: Tables) -> DataFrame:
    return rounded(token_rows(t).filter("df >= 5"))


@query("token_top", "select token, df from tok order by df desc, token limit 200", TOKENS)
def token_top(t: Tables) -> DataFrame:
    return token_rows(t).orderBy(F.desc("df"), "token").limit(200).select("token", "df")


@query("token_groups", """select g, count(*) as n from (select case when token in ('the', 'and') then 'lexicon' when z > 3 and lift >= 1.5 then 'off_skew' when z < -3 and lift <= 1 / 1.5 then 'not_skew' else 'unremarkable' end as g
from (select token, round((df1 / df) / (n1 / n), 6) as lift, round((df1 - df * (n1 / n)) / sqrt(df * (n1 / n) * (1 - n1 / n)), 6) as z from tok, tot where df >= 5)) group by g""", TOKENS)
def token_groups(t: Tables) -> DataFrame:
    rows = rounded(token_rows(t).filter("df >= 5"))
    g = ev.token_group(F.col("z"), F.col("lift"), F.col("token").isin("the", "and"), 3.0, 1.5)
    return rows.groupBy(g.alias("g")).agg(F.count("*").alias("n"))


@query("bonferroni_bound")
def bonferroni(t: Tables) -> DataFrame:
    n = token_rows(t).filter("df >= 5").count()
    return t.spark.createDataFrame([(n, round(ev.norm_ppf(1 - 0.05 / 2 / max(1, n)), 6))], "tests long, z double")


@query("stratum_rate", """, a as (select n_chars // 1000 as stratum, count(*) as w from scored where slice = 'hit' group by 1), b as (select n_chars // 1000 as stratum, avg(gold) as r from scored where slice = 'free' group by 1)
select round(sum(w * r) / sum(w), 6) as rate, cast(sum(w) as bigint) as weight from a join b using (stratum)""")
def stratum_rate(t: Tables) -> DataFrame:
    rows = t.scored.withColumn("stratum", F.floor(F.col("n_chars") / 1000))
    return rounded(ev.stratum_rate(rows.filter("slice = 'hit'"), rows.filter("slice = 'free'")))


@query("class_balance", """select part, coalesce(slice, 'all') as slice, count(*) as n, count_if(gold = 1) as positive, round(avg(gold), 6) as rate, round(count_if(gold = 0) / nullif(count_if(gold = 1), 0), 6) as ratio from (select *, case when row_id % 2 = 0 then 'even' else 'odd' end as part from scored) group by grouping sets ((part, slice), (part))""")
def class_balance(t: Tables) -> DataFrame:
    part = F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd")
    rows = t.scored.withColumn("part", part).groupingSets([[F.col("part"), F.col("slice")], [F.col("part")]], F.col("part"), F.col("slice"))
    n1 = F.count_if(GOLD() == 1)
    got = rows.agg(F.count("*").alias("n"), n1.alias("positive"), F.avg(GOLD().cast("double")).alias("rate"), ev.ratio(F.count_if(GOLD() == 0), n1).alias("ratio"))
    return rounded(got.withColumn("slice", F.coalesce("slice", F.lit("all"))))


@query("stratified_split_sizes", "select gold, case when part then 'dev' else 'train' end as part, case when part then round_even(n * 0.2, 0)::bigint else n - round_even(n * 0.2, 0)::bigint end as n from (select gold, count(*) as n from scored group by 1), (select unnest([true, false]) as part)")
def split_sizes(t: Tables) -> DataFrame:
    return ev.stratified_split(t.scored, 0.2, 42).groupBy("gold", "part").agg(F.count("*").alias("n"))


@query("stratified_split", "select row_id, gold, case when r <= round_even(n * 0.5, 0) then 'dev' else 'train' end as part from (select row_id, gold, row_number() over (partition by gold order by md5(row_id || '|7'), cast(row_id as varchar)) as r, count(*) over (partition by gold) as n from scored)")
def split(t: Tables) -> DataFrame:
    return ev.stratified_split(t.scored, 0.5, 7).select("row_id", "gold", "part")


@query("stratified_folds", "select gold, fold, (n + 4 - fold) // 5 as n from (select gold, count(*) as n from scored group by 1), (select unnest(range(5))::int as fold)")
def folds(t: Tables) -> DataFrame:
    return ev.stratified_folds(t.scored, 5, 42).groupBy("gold", "fold").agg(F.count("*").alias("n"))


@query("stratified_fold_of_rows", "select row_id, cast((row_number() over (partition by gold order by md5(row_id || '|42'), cast(row_id as varchar)) - 1) % 5 as int) as fold from scored")
def fold_of_rows(t: Tables) -> DataFrame:
    return ev.stratified_folds(t.scored, 5, 42).select("row_id", "fold")


@query("fingerprint", "select sha256(string_agg(row_id, chr(10) order by row_id)) as sha256, count(*) as n, count(*) - count(distinct row_id) as repeated from (select cast(row_id as varchar) as row_id from scored)")
def fingerprint(t: Tables) -> DataFrame:
    return ev.fingerprint(t.scored)


@query("quantile_edges", "select share, list_extract(l, least(n - 1, floor(share * n))::int + 1) as edge from (select list(n_chars order by n_chars) as l, count(*) as n from scored), (select unnest([0.25::double, 0.5, 0.75]) as share)")
def quantile_edges(t: Tables) -> DataFrame:
    return ev.quantile_edges(t.scored, "n_chars", [0.25, 0.5, 0.75])


@query("upsampled_union", "select gold, count(*) as n from (select gold from scored union all select gold from scored, (select unnest(range(3))) where gold = 1) group by gold")
def upsampled(t: Tables) -> DataFrame:
    more = t.scored.filter("gold = 1").select("gold", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return t.scored.select("gold").unionByName(more.select("gold")).groupBy("gold").agg(F.count("*").alias("n"))


@query("label_conflicts", "select row_id from (select row_id, gold from scored union all select row_id, case when row_id % 13 = 0 then 1 - gold else gold end from scored where row_id % 2 = 1) group by row_id having count(distinct gold) > 1")
def label_conflicts(t: Tables) -> DataFrame:
    other = t.scored.filter("row_id % 2 = 1").select("row_id", F.when(F.col("row_id") % 13 == 0, 1 - GOLD()).otherwise(GOLD()).alias("gold"))
    return t.scored.select("row_id", "gold").unionByName(other).groupBy("row_id").agg(F.count_distinct("gold").alias("k")).filter("k > 1").select("row_id")


@query("labels_joined", "select d.doc_id as row_id, coalesce(cast(l.toxic as int), -100) as label from documents d left join labels l using (doc_id)")
def labels_joined(t: Tables) -> DataFrame:
    lab = t.raw("labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return t.raw("documents").select("doc_id").join(lab, "doc_id", "left").select(F.col("doc_id").alias("row_id"), F.coalesce("label", F.lit(-100)).alias("label"))


@query("id_set_algebra", "select 'both' as part, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all select 'unlabelled', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'any', count(*) from (select doc_id from documents union select doc_id from labels)")
def id_sets(t: Tables) -> DataFrame:
    a, b = t.raw("documents").select("doc_id"), t.raw("labels").select("doc_id")
    parts = {"both": a.intersect(b), "unlabelled": a.subtract(b), "any": a.union(b).distinct()}
    out = None
    for k, d in parts.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("multiset_difference", "select row_id from (select row_id from scored union all select row_id from scored where row_id % 9 = 0) except all select row_id from scored")
def multiset(t: Tables) -> DataFrame:
    a = t.scored.select("row_id")
    return a.union(a.filter("row_id % 9 = 0")).exceptAll(a)


@query("latency_bands", """, m as (select case when length(raw_text) <= 12 then 12 when length(raw_text) <= 14 then 14 else 5000 end as band, latency_ms from comments)
select band, count(*) as n, list_extract(list(latency_ms order by latency_ms), greatest(1, round_even(0.95::double * count(*), 0)::int)) as p95 from m group by band""")
def latency_bands(t: Tables) -> DataFrame:
    """p95 by nearest rank, max(1, half-even round of q n), from the distinct latencies of each band."""
    from pyspark.sql import Window as W

    n = F.length("raw_text")
    rows = t.comments.select(F.when(n <= 12, 12).when(n <= 14, 14).otherwise(5000).alias("band"), "latency_ms")
    g = rows.groupBy("band", "latency_ms").agg(F.count("*").alias("k"))
    g = g.withColumn("upto", F.sum("k").over(W.partitionBy("band").orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(W.partitionBy("band")))
    rank = F.greatest(F.lit(1), F.bround(0.95 * F.col("n")))
    return g.filter(F.col("upto") >= rank).groupBy("band").agg(F.max("n").alias("n"), F.min("latency_ms").alias("p95"))


@query("system_comparison", """select system, round(avg(((s >= 0.4)::int = gold)::int), 6) as accuracy, round(count_if(s >= 0.4 and gold = 1) / count_if(gold = 1), 6) as recall from (select 'base' as system, p as s, gold from scored union all select 'next', p2, gold from scored) group by system""")
def system_comparison(t: Tables) -> DataFrame:
    long = t.scored.select("gold", F.explode(F.array(F.struct(F.lit("base").alias("system"), P().alias("s")), F.struct(F.lit("next").alias("system"), F.col("p2").alias("s")))).alias("x")).select("gold", "x.*")
    g = long.groupBy("system").agg(*ev.cells(F.col("s") >= 0.4))
    return rounded(g.select("system", *ev.metrics()).select("system", "accuracy", "recall"))


def _cells(t: Tables) -> DataFrame:
    return t.scored.agg(*ev.cells(P() >= T))


@query("bootstrap_f1")
def bootstrap_f1(t: Tables) -> DataFrame:
    return rounded(ev.interval(ev.resampled(_cells(t), ["tn", "fp", "fn", "tp"], ev.f1_of, 1000, 42)))


@query("bootstrap_paired_delta")
def bootstrap_delta(t: Tables) -> DataFrame:
    """Accuracy of the second system minus the first, over joint outcomes, so both see the same rows."""
    a, b = (P() >= 0.4).cast("int") == GOLD(), (F.col("p2") >= 0.4).cast("int") == GOLD()
    joint = t.scored.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("none"))
    return rounded(ev.interval(ev.resampled(joint, ["both", "a_only", "b_only", "none"], lambda c: (c["b_only"] - c["a_only"]) / max(1, sum(c.values())), 1000, 42)))


@query("bootstrap_recall_gap")
def bootstrap_gap(t: Tables) -> DataFrame:
    """Recall of the hit slice minus the free slice; the disjoint slices are resampled apart."""
    of = lambda s, ok: F.count_if((F.col("slice") == s) & (GOLD() == 1) & ((P() >= T) == ok))
    row = t.scored.agg(of("hit", True).alias("hit_tp"), of("hit", False).alias("hit_fn"), of("free", True).alias("free_tp"), of("free", False).alias("free_fn"))

    def gap(c: dict) -> float | None:
        a, b = c["hit_tp"] + c["hit_fn"], c["free_tp"] + c["free_fn"]
        return c["hit_tp"] / a - c["free_tp"] / b if a and b else None

    got = ev.interval(ev.resampled(row, list(row.columns), gap, 1000, 42, [["hit_tp", "hit_fn"], ["free_tp", "free_fn"]]))
    point = row.select((F.col("hit_tp") / (F.col("hit_tp") + F.col("hit_fn")) - F.col("free_tp") / (F.col("free_tp") + F.col("free_fn"))).alias("gap"), sum(F.col(c) for c in row.columns).alias("n"))
    return rounded(point.crossJoin(got).withColumn("verdict", ev.verdict(F.col("gap"), F.col("low"), F.col("high"), F.col("n"), 30)))


@query("bootstrap_cost")
def bootstrap_cost(t: Tables) -> DataFrame:
    cost = lambda c: (3.0 * c["fn"] + c["fp"]) / max(1, sum(c.values()))
    return rounded(ev.interval(ev.resampled(_cells(t), ["tn", "fp", "fn", "tp"], cost, 1000, 42, [["tn", "fp"], ["fn", "tp"]])))


def _classes(rows: DataFrame, keys: dict[str, Column]) -> list[list[tuple]]:
    """Joint outcomes of each class, which is resampled on its own."""
    return [ev.outcomes(rows, keys, GOLD() == g) for g in (0, 1)]


def _by(drawn: list, place: int) -> tuple[dict, dict]:
    """(positive, negative) counts by one of the keys."""
    out: list[dict] = []
    for s in drawn:
        of: dict = {}
        for key, n in s:
            of[key[place]] = of.get(key[place], 0) + n
        out.append(of)
    return out[1], out[0]


@query("bootstrap_auc")
def bootstrap_auc(t: Tables) -> DataFrame:
    """Areas of both systems, their difference, and that of the one chosen in the replicate, by distinct scores; 10 000 replicates."""

    def areas(drawn: list) -> list:
        a, b = (ev.area(*_by(drawn, i)) for i in (0, 1))
        return [a, b, b - a, max(a, b)] if a is not None else [None] * 4

    strata = _classes(t.scored, {"p": P(), "p2": F.col("p2")})
    return rounded(ev.intervals(ev.replicated(t.spark, strata, areas, ["base", "next", "delta", "chosen"], 10_000, 42, 16)))


@query("bootstrap_threshold_stability")
def bootstrap_threshold(t: Tables) -> DataFrame:
    """The threshold of least cost fitted anew in each replicate; q1 and q3 tell how stable it is."""
    strata = _classes(t.scored, {"p": P()})
    return rounded(ev.intervals(ev.replicated(t.spark, strata, lambda drawn: [ev.least_cost(*_by(drawn, 0))], ["threshold"], 2000, 43)))


@query("bootstrap_matched")
def bootstrap_matched(t: Tables) -> DataFrame:
    """Recall of the second system less that of the first where both flag as many rows (or the next more) as the first does at its fixed threshold."""

    def recall_at(pos: dict, neg: dict, flags: int) -> float:
        hit = seen = 0
        for x in sorted(pos.keys() | neg.keys(), reverse=True):
            if seen >= flags:
                break
            hit, seen = hit + pos.get(x, 0), seen + pos.get(x, 0) + neg.get(x, 0)
        return hit / max(1, sum(pos.values()))

    def delta(drawn: list) -> list:
        (pos, neg), second = _by(drawn, 0), _by(drawn, 1)
        flags = sum(n for of in (pos, neg) for x, n in of.items() if x >= T)
        return [recall_at(*second, flags) - recall_at(pos, neg, flags), float(flags)]

    return rounded(ev.intervals(ev.replicated(t.spark, _classes(t.scored, {"p": P(), "p2": F.col("p2")}), delta, ["recall_delta", "flags"], 2000, 44)))


@query("bootstrap_operating_point")
def bootstrap_operating_point(t: Tables) -> DataFrame:
    """Deferral, capture of errors and risk of the automatic part at a fixed confidence, by slice, the slices resampled apart."""
    sure = F.greatest(P(), 1 - P()) >= 0.6
    wrong = (P() >= 0.5).cast("int") != GOLD()
    slices = ("free", "hit")
    strata = [ev.outcomes(t.scored, {"sure": sure, "wrong": wrong}, F.col("slice") == s) for s in slices]

    def point(drawn: list) -> list:
        out = []
        for s in drawn:
            of = dict(s)
            n, deferred = sum(of.values()), of.get((False, False), 0) + of.get((False, True), 0)
            errors, kept = of.get((False, True), 0) + of.get((True, True), 0), of.get((True, True), 0)
            out += [deferred / n if n else None, (errors - kept) / errors if errors else None, kept / (n - deferred) if n - deferred else None]
        return out

    names = [f"{s}_{x}" for s in slices for x in ("deferral", "capture", "auto_risk")]
    return rounded(ev.intervals(ev.replicated(t.spark, strata, point, names, 2000, 45)))


@query("bootstrap_per_code")
def bootstrap_per_code(t: Tables) -> DataFrame:
    """Precision, recall, F1 and false positive rate of two codes (each system's flag is one), from the same resamples."""
    strata = [ev.outcomes(t.scored, {"gold": GOLD(), "a": P() >= 0.4, "b": F.col("p2") >= 0.4})]

    def scores(drawn: list) -> list:
        out = []
        for code in (1, 2):
            c = {(g, f): sum(n for k, n in drawn[0] if k[0] == g and k[code] == f) for g in (0, 1) for f in (False, True)}
            tp, fp, fn, tn = c[1, True], c[0, True], c[1, False], c[0, False]
            div = lambda a, b: a / b if b else None
            out += [div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn), div(fp, fp + tn)]
        return out

    names = [f"{c}_{m}" for c in ("a", "b") for m in ("precision", "recall", "f1", "fpr")]
    return rounded(ev.intervals(ev.replicated(t.spark, strata, scores, names, 2000, 46)))


@query("bootstrap_system_deltas")
def bootstrap_system_deltas(t: Tables) -> DataFrame:
    """Each metric of the second system less that of the first on the same resampled rows, over all rows and in each slice."""
    strata = [ev.outcomes(t.scored, {"slice": F.col("slice"), "gold": GOLD(), "a": P() >= 0.4, "b": F.col("p2") >= 0.4})]
    slices = ("all", "free", "hit")

    def deltas(drawn: list) -> list:
        out = []
        for s in slices:
            rows = [(k, n) for k, n in drawn[0] if s in ("all", k[0])]
            total = sum(n for _, n in rows)
            flagged = [sum(n for k, n in rows if k[i] and k[1] == 1) for i in (2, 3)]
            right = [sum(n for k, n in rows if k[i] == (k[1] == 1)) for i in (2, 3)]
            pos = sum(n for k, n in rows if k[1] == 1)
            out += [(flagged[1] - flagged[0]) / pos if pos else None, (right[1] - right[0]) / total if total else None]
        return out

    return rounded(ev.intervals(ev.replicated(t.spark, strata, deltas, [f"{s}_{m}" for s in slices for m in ("recall", "accuracy")], 2000, 47)))


@query("bootstrap_calibration")
def bootstrap_calibration(t: Tables) -> DataFrame:
    """Expected calibration error by tenths, each class resampled on its own."""
    at = F.least(F.floor(P() / 0.1), F.lit(9)).cast("int")
    row = t.scored.agg(*(F.count_if((at == i) & (GOLD() == g)).alias(f"{'np'[g]}{i}") for i in range(10) for g in (0, 1)))
    centre = {r["b"]: r["c"] for r in t.scored.groupBy(at.alias("b")).agg(F.avg("p").alias("c")).collect()}

    def ece(c: dict) -> float:
        n = max(1, sum(c.values()))
        return sum(abs(c[f"p{i}"] - (c[f"p{i}"] + c[f"n{i}"]) * centre.get(i, 0.0)) for i in range(10)) / n

    return rounded(ev.interval(ev.resampled(row, row.columns, ece, 1000, 42, [[n for n in row.columns if n[0] == k] for k in "pn"])))
