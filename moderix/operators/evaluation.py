"""Evaluation operators over scored rows (row_id, gold, p, ..., slice).

Curves are built from one row per distinct score: a score's group is aggregated first, and running sums over these
rows give ranks, areas and costs. Running sums are made in two levels (``running``): sums of ``RANGES`` equal ranges of the score, which are
few, and sums within a range, so no task holds all rows or all distinct scores. Where a statistic has a fixed tie or
rounding rule it is stated beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def cells(flag: Column, gold: Column = None) -> list[Column]:  # noqa: RUF013
    g = F.col("gold") if gold is None else gold
    return [F.count_if((g == 0) & ~flag).alias("tn"), F.count_if((g == 0) & flag).alias("fp"), F.count_if((g == 1) & ~flag).alias("fn"), F.count_if((g == 1) & flag).alias("tp")]


def metrics() -> list[Column]:
    """precision, recall, F1 (0 where there is no positive at all), macro F1, accuracy and false positive rate from the cells."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1 = lambda a, b, c: F.coalesce(ratio(2.0 * a, 2 * a + b + c), F.lit(0.0))
    return [
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(fp, fp + tn).alias("fpr"),
    ]


def by_slice(rows: DataFrame, flag: Column, key: str = "slice") -> DataFrame:
    """Cells of all rows and of each slice, in one pass."""
    return rows.groupingSets([[F.col(key)], []], F.col(key)).agg(*cells(flag)).withColumn(key, F.coalesce(key, F.lit("all")))


def score_groups(rows: DataFrame, score: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, score).agg(F.count_if(F.col("gold") == 1).alias("pos"), F.count_if(F.col("gold") == 0).alias("neg"))


RANGES = 4096


def running(groups: DataFrame, by: str, sums: dict[str, str], keys: list[str], descending: bool = False) -> DataFrame:
    """groups with a column for each of ``sums`` (new name: summed column): its sum over all groups of the same keys that come before in
    order of ``by``, the own one left out. Groups of equal ``by`` have no order among themselves, so there should be one for each."""
    bounds = groups.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), F.floor((F.col(by) - F.col("_low")) / (F.col("_high") - F.col("_low")) * (RANGES - 1))).otherwise(0)
    placed = groups.crossJoin(F.broadcast(bounds)).withColumn("_range", at.cast("long")).drop("_low", "_high")
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    past = (W.unboundedPreceding, -1)
    of_ranges = placed.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    over_ranges = W.partitionBy(*keys).orderBy(order("_range")).rowsBetween(*past)
    of_ranges = of_ranges.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_{n}").over(over_ranges), F.lit(0)).alias(f"_{n}") for n in sums))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    within = W.partitionBy(*keys, "_range").orderBy(order(by)).rowsBetween(*past)
    return placed.join(of_ranges, same).select(*groups.columns, *((F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()))


def auc(rows: DataFrame, score: str = "p", keys: tuple[str, ...] = (), tie_credit: float = 0.5) -> DataFrame:
    """Mann-Whitney area; a tie between a positive and a negative earns ``tie_credit``."""
    ks = list(keys)
    g = running(score_groups(rows, score, ks), score, {"below": "neg"}, ks)
    won = F.sum(F.col("pos") * (F.col("below") + tie_credit * F.col("neg")))
    return g.groupBy(*ks).agg(ratio(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def average_precision(rows: DataFrame, score: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """Steps at distinct scores, from the highest: recall gained times precision so far."""
    ks = list(keys)
    g = score_groups(rows, score, ks).withColumn("own", F.col("pos") + F.col("neg"))
    g = running(g, score, {"tp": "pos", "n": "own"}, ks, True).withColumn("tp", F.col("tp") + F.col("pos")).withColumn("n", F.col("n") + F.col("own"))
    return g.groupBy(*ks).agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos")).alias("ap"))


def threshold_curve(rows: DataFrame, score: str = "p", cost_ratio: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """For every distinct score t, and one below all: cells, cost and flags of the rule score > t.

    cost = (ratio * missed + false alarms) / rows.
    """
    ks = list(keys)
    g = score_groups(rows, score, ks)
    low = g.groupBy(*ks).agg((F.min(score) - 1e-6).alias(score)).withColumn("pos", F.lit(0)).withColumn("neg", F.lit(0))
    g = g.unionByName(low.select(g.columns))
    g = running(g, score, {"fn": "pos", "tn": "neg"}, ks).withColumn("fn", F.col("fn") + F.col("pos")).withColumn("tn", F.col("tn") + F.col("neg"))
    whole = g.groupBy(*ks).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    g = (g.join(whole, ks) if ks else g.crossJoin(F.broadcast(whole))).withColumn("tp", F.col("_pos") - F.col("fn")).withColumn("fp", F.col("_neg") - F.col("tn"))
    cost = (F.col("fn") * cost_ratio + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return g.select(*ks, F.col(score).alias("t"), "tn", "fp", "fn", "tp", (F.col("tp") + F.col("fp")).alias("flags"), cost.alias("cost"))


def fit_threshold(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of least cost; among equals the lowest."""
    best = F.min_by(F.struct("t", "cost", "tp", "fp", "fn", "tn"), F.struct("cost", "t"))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def fit_pair(curve_a: DataFrame, curve_b: DataFrame, cap: int) -> DataFrame:
    """Thresholds of two slices under a cap on all flags: most flags, then least cost, then lowest.

    For each threshold of a the best of b is that of most flags within the rest of the cap; curve b is reduced to a running best by flags and
    met by an equi-join on the capped rest, so no pair of curves is enumerated.
    """
    a = curve_a.select(F.col("t").alias("t_a"), F.col("flags").alias("flags_a"), (F.col("fn") * 3.0 + F.col("fp")).alias("c_a")).filter(F.col("flags_a") <= cap)
    b = curve_b.groupBy("flags").agg(F.min_by(F.struct((F.col("fn") * 3.0 + F.col("fp")).alias("c"), F.col("t").alias("t")), F.struct((F.col("fn") * 3.0 + F.col("fp")), F.col("t"))).alias("b"))
    events = a.select((cap - F.col("flags_a")).alias("flags"), F.lit(1).alias("ask"), F.lit(None).cast(b.schema["b"].dataType).alias("b"), F.struct("t_a", "flags_a", "c_a").alias("a"))
    both = events.unionByName(b.select("flags", F.lit(0).alias("ask"), "b", F.lit(None).cast(events.schema["a"].dataType).alias("a")))
    both = _last_offer(both.withColumn("held", F.when(F.col("ask") == 0, F.struct("flags", "b"))), cap)
    rows = both.filter("ask = 1 and held is not null").select("a.*", F.col("held.flags").alias("flags_b"), F.col("held.b.c").alias("c_b"), F.col("held.b.t").alias("t_b"))
    flags, cost = F.col("flags_a") + F.col("flags_b"), F.col("c_a") + F.col("c_b")
    best = F.min_by(F.struct("t_a", "t_b", flags.alias("flags"), cost.alias("cost")), F.struct(-flags, cost, "t_a", "t_b"))
    return rows.agg(best.alias("x")).select("x.*")


def _last_offer(both: DataFrame, cap: int) -> DataFrame:
    """The last ``held`` at or before each row in order of flags (offers first), by ranges of flags: what a range begins with is the last of those
    before it."""
    at = F.floor(F.col("flags") * RANGES / (cap + 1)).cast("long")
    both = both.withColumn("_range", at)
    ends = both.groupBy("_range").agg(F.max(F.when(F.col("ask") == 0, F.col("flags"))).alias("_flags"), F.max_by("held", F.when(F.col("ask") == 0, F.col("flags"))).alias("_end"))
    begins = ends.select("_range", F.last("_end", True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_begin"))
    own = F.last("held", True).over(W.partitionBy("_range").orderBy("flags", "ask").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_own", own).join(begins, "_range").withColumn("held", F.coalesce("_own", "_begin")).drop("_range", "_own", "_begin")


def reliability(rows: DataFrame, p: Column, right: Column, low: float, high: float, n: int) -> DataFrame:
    """Equal bins of [low, high], the last closed; empty bins stay with nulls."""
    width = (high - low) / n
    at = F.least(F.floor((p - low) / width), F.lit(n - 1)).cast("long")
    got = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(right.cast("double")).alias("accuracy"))
    return rows.sparkSession.range(n).withColumnRenamed("id", "bin").join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "confidence", "accuracy")


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected, greatest and signed gap of a reliability table."""
    gap = F.col("accuracy") - F.col("confidence")
    total = F.sum("n")
    return bins.agg((F.sum(F.col("n") * F.abs(gap)) / total).alias("ece"), F.max(F.abs(gap)).alias("mce"), (F.sum(F.col("n") * gap) / total).alias("signed"))


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def tempered(p: Column, t: Column | float) -> Column:
    x = F.log(clipped(p) / (1 - clipped(p)))
    return 1 / (1 + F.exp(-x / t))


def nll(rows: DataFrame, p: str, temperatures: list[float]) -> DataFrame:
    """Mean negative log likelihood at each of some temperatures, in one pass over the rows."""
    def loss(t: float) -> Column:
        q = clipped(tempered(F.col(p), t))
        return F.avg(-F.when(F.col("gold") == 1, F.log(q)).otherwise(F.log(1 - q)))

    one = rows.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(temperatures)))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures))))
    return one.select(pairs.alias("x")).select("x.*")


def fit_temperature(rows: DataFrame, p: str = "p", low: float = 0.05, high: float = 20.0, points: int = 41, rounds: int = 3) -> tuple[float, bool]:
    """(temperature, at the boundary): a log grid, then finer grids around its best; each grid is one aggregation."""
    from math import exp, log

    a, b, at, edge = log(low), log(high), 0, False
    for k in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        losses = [r.nll for r in nll(rows, p, [exp(g) for g in grid]).collect()]
        at = min(range(points), key=lambda i: losses[i])
        edge = edge or (k == 0 and at in (0, points - 1))
        a, b = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return exp((a + b) / 2), edge


def risk_coverage(rows: DataFrame, confidence: Column, right: Column, coverages: list[float]) -> DataFrame:
    """Error among the k most confident rows, k = max(1, half-even round of coverage times n).

    Rows are taken by confidence, ties by row_id. Confidence levels are counted first; only the levels in which a cut falls are ranked row by row.
    """
    spark = rows.sparkSession
    base = rows.select("row_id", confidence.alias("c"), right.cast("long").alias("ok"))
    levels = base.groupBy("c").agg(F.count("*").alias("k"), F.sum("ok").alias("ok"))
    levels = running(levels, "c", {"before": "k", "ok_before": "ok"}, [], True)
    cover = spark.createDataFrame([(float(x),) for x in coverages], "coverage double")
    cuts = cover.crossJoin(base.agg(F.count("*").alias("n"))).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("n"))).cast("long"))
    at = cuts.withColumnRenamed("k", "take").join(levels.withColumnRenamed("k", "size"), (F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("size")))
    inside = base.join(at.select("c").distinct(), "c").withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("row_id")))
    part = at.join(inside.select("c", "r", F.col("ok").alias("own")), "c").filter(F.col("r") <= F.col("take") - F.col("before"))
    got = part.groupBy("coverage", "take", "ok_before").agg(F.sum("own").alias("own"))
    return got.select("coverage", F.col("take").alias("k"), (1 - (F.col("ok_before") + F.col("own")) / F.col("take")).alias("risk"))


def operating_point(rows: DataFrame, confidence: Column, flag: Column, threshold: float) -> DataFrame:
    """Automatic above the threshold, deferred below: per slice the deferral, cells of the automatic part and capture lift."""
    right = flag.cast("int") == F.col("gold")
    auto = confidence >= threshold
    g = rows.groupingSets([[F.col("slice")], []], F.col("slice")).agg(F.count("*").alias("n"), F.count_if(~auto).alias("deferred"), F.count_if(~right).alias("errors"), F.count_if(~right & ~auto).alias("captured"), F.count_if(auto & ~right).alias("auto_errors"))
    share, kept = ratio(F.col("deferred"), F.col("n")), ratio(F.col("captured"), F.col("errors"))
    return g.select(F.coalesce("slice", F.lit("all")).alias("slice"), "n", "deferred", share.alias("deferral"), kept.alias("capture"), ratio(kept, share).alias("lift"), ratio(F.col("auto_errors"), F.col("n") - F.col("deferred")).alias("auto_risk"))


def crossings(rows: DataFrame, a: str, b: str, t: float) -> DataFrame:
    up, down = (F.col(a) < t) & (F.col(b) >= t), (F.col(a) >= t) & (F.col(b) < t)
    return rows.agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"), (F.count_if(up) - F.count_if(down)).alias("net"))


def kappa(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement and Cohen's kappa of two yes-or-no labels; null kappa if chance agreement is 1."""
    g = pairs.agg(F.count("*").alias("n"), F.count_if(a == b).alias("same"), F.count_if(a == 1).alias("a1"), F.count_if(b == 1).alias("b1"))
    n = F.col("n").cast("double")
    chance = (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n)
    agree = F.col("same") / n
    return g.select("n", (agree * 100).alias("agreement_pct"), ratio(agree - chance, 1 - chance).alias("kappa"))


def aligned(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of two dumps that do not pair up: missing on a side or different in a field."""
    x = a.select("row_id", *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("in_a"))
    y = b.select("row_id", *(F.col(f).alias(f"b_{f}") for f in fields), F.lit(True).alias("in_b"))
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    why = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("differs")
    return x.join(y, "row_id", "full_outer").filter(F.col("in_a").isNull() | F.col("in_b").isNull() | differ).select("row_id", why.alias("problem"))


def norm_ppf(q: float) -> float:
    """The normal distribution's quantile."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(q)


def _runs(ordered: Column) -> Column:
    """(token, k) of each run of equal values."""
    n = F.size(ordered)
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
    found = lambda at: F.transform(at, lambda i, j: F.struct(F.get(ordered, i - 1).alias("token"), (F.coalesce(F.get(at, j + 1), n + 1) - i).alias("k")))
    return F.transform(F.array(starts), found)[0]


def token_table(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Per token: documents, positive documents, occurrences, lift, z against the base rate, excess positives.

    Counts are aggregated by token; the totals are one row, joined as such.
    """
    n = rows.agg(F.count("*").alias("n"), F.sum("gold").alias("n1"))
    each = rows.select("gold", F.explode(F.transform(F.array(F.array_sort(tokens)), _runs)[0]).alias("x")).select("gold", "x.token", "x.k")
    t = each.groupBy("token").agg(F.count("*").alias("df"), F.sum("gold").alias("df1"), F.sum("k").alias("occurrences")).crossJoin(F.broadcast(n))
    base, df = F.col("n1") / F.col("n"), F.col("df")
    sd = F.sqrt(df * base * (1 - base))
    return t.select("token", "df", "df1", "occurrences", ratio(F.col("df1") / df, base).alias("lift"), ratio(F.col("df1") - df * base, sd).alias("z"), (F.col("df1") - df * base).alias("excess"))


def token_group(z: Column, lift: Column, lexicon: Column, bound: float, floor: float) -> Column:
    return F.when(lexicon, "lexicon").when((z > bound) & (lift >= floor), "off_skew").when((z < -bound) & (lift <= 1 / floor), "not_skew").otherwise("unremarkable")


def stratum_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's rate with its strata weighted as in a; strata that either lacks drop out of both."""
    x = a.groupBy("stratum").agg(F.count("*").alias("w"))
    y = b.groupBy("stratum").agg(F.avg(F.col("gold").cast("double")).alias("r"))
    return x.join(y, "stratum").agg(ratio(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("rate"), F.sum("w").alias("weight"))


def seeded(key: Column, seed: int) -> Column:
    """The seeded hash by which rows are dealt: MD5 of ``key|seed``, in hexadecimal digits."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def stratified_split(rows: DataFrame, share: float, seed: int, key: str = "row_id", label: str = "gold") -> DataFrame:
    """rows plus ``part``: of each class half-even round of n times share go to dev, by least seeded hash, ties by id.

    Independent of row order. The cut is a count per class and hash range first; only the hash ranges in which a cut falls are ranked.
    """
    base = rows.withColumn("_h", seeded(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = base.groupBy(label, "_b").agg(F.count("*").alias("_k"))
    total = sizes.groupBy(label).agg(F.bround(F.sum("_k") * share).cast("long").alias("_want"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.withColumn("_before", before).join(total, label).select(label, "_b", (F.col("_want") - F.col("_before")).alias("_left"))
    ranked = base.join(cut, [label, "_b"]).withColumn("_r", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", F.col(key).cast("string"))))
    return ranked.withColumn("part", F.when(F.col("_r") <= F.col("_left"), "dev").otherwise("train")).drop("_h", "_b", "_left", "_r")


def stratified_folds(rows: DataFrame, k: int, seed: int, key: str = "row_id", label: str = "gold") -> DataFrame:
    """rows plus ``fold``: each class is dealt round-robin in order of seeded hash, ties by id."""
    base = rows.withColumn("_h", seeded(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = base.groupBy(label, "_b").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = base.join(sizes.select(label, "_b", before.alias("_before")), [label, "_b"]).withColumn("_r", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", F.col(key).cast("string"))))
    return ranked.withColumn("fold", ((F.col("_before") + F.col("_r") - 1) % k).cast("int")).drop("_h", "_b", "_before", "_r")


def fingerprint(ids: DataFrame, key: str = "row_id") -> DataFrame:
    """SHA-256 of the sorted ids joined by line ends: one value by nature, made of one short string per id."""
    return ids.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "\n").cast("binary"), 256).alias("sha256"), F.count("*").alias("n"), (F.count("*") - F.count_distinct(key)).alias("repeated"))


def quantile_edges(rows: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """Nearest-rank edges, index min(n - 1, floor(share * n)), from counts per distinct value."""
    g = running(rows.groupBy(x).agg(F.count("*").alias("k")), x, {"before": "k"}, []).withColumn("upto", F.col("before") + F.col("k"))
    n = rows.agg(F.count("*").alias("n"))
    want = rows.sparkSession.createDataFrame([(float(s),) for s in shares], "share double").crossJoin(n).withColumn("i", F.least(F.col("n") - 1, F.floor(F.col("share") * F.col("n"))))
    return F.broadcast(want).join(g, F.col("upto") > F.col("i")).groupBy("share").agg(F.min(x).alias("edge"))


# -- resampling ---------------------------------------------------------------------------------------------------

#: Most joint outcomes that a resampling holds; more is refused.
OUTCOMES = 1_000_000


def outcomes(rows: DataFrame, keys: dict[str, Column], where: Column | None = None) -> list[tuple]:
    """(key values..., count) of each joint outcome of some rows, in order; as many as there are distinct outcomes, such as scores."""
    g = (rows if where is None else rows.filter(where)).groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.count("*").alias("_k"))
    got = g.limit(OUTCOMES + 1).collect()
    if len(got) > OUTCOMES:
        raise ValueError(f"more than {OUTCOMES} distinct outcomes: round the scores first")
    return sorted((tuple(r) for r in got), key=lambda r: tuple((x is None, x) for x in r))


def replicated(spark: SparkSession, strata: list[list[tuple]], statistic: Callable, names: list[str], replicates: int, seed: int, tasks: int = 8) -> DataFrame:
    """(replicate, names...): statistics of resampled outcomes, several from each resample.

    Resampling rows with replacement is a multinomial draw of the counts of their joint outcomes, exact in distribution, so a replicate costs a draw for each distinct
    outcome and not a pass over the rows. Each list of (key values..., count) is resampled on its own. statistic gets the strata as [(key values, drawn)] and
    gives a float or None for each name; replicates run on executors, each from its own seed.
    """
    import numpy as np

    totals = [sum(r[-1] for r in s) for s in strata]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for r in f["id"]:
                rng = np.random.default_rng([seed, int(r)])
                drawn = [list(zip((x[:-1] for x in s), rng.multinomial(n, [x[-1] / n for x in s]).tolist() if n else [], strict=bool(n))) for s, n in zip(strata, totals, strict=True)]
                out.append([int(r), *statistic(drawn)])
            made = pd.DataFrame(out, columns=["replicate", *names])
            yield made.astype({"replicate": "int64"} | dict.fromkeys(names, "float64"))

    return spark.range(0, replicates, 1, tasks).mapInPandas(run, ", ".join(["replicate long", *(f"`{n}` double" for n in names)]))


def resampled(counts: DataFrame, names: list[str], statistic: Callable, replicates: int, seed: int, strata: list[list[str]] | None = None, tasks: int = 8) -> DataFrame:
    """(replicate, value) of a statistic of resampled counts: ``counts`` is one row with the counts of the joint outcomes ``names``; outcomes of one of
    ``strata`` are resampled among themselves. statistic(dict) gives a float or None."""
    row = counts.select(*names).first()
    held = [[(n, int(row[n])) for n in g] for g in strata or [names]]
    return replicated(counts.sparkSession, held, lambda drawn: [statistic({k[0]: c for s in drawn for k, c in s})], ["value"], replicates, seed, tasks)


def intervals(values: DataFrame, level: float = 0.95) -> DataFrame:
    """(name, low, high, q1, q3, used, undefined) of every statistic of some replicates."""
    names = [c for c in values.columns if c != "replicate"]
    a = (1 - level) / 2
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names)))
    long = values.select(each.alias("x")).select("x.*")
    q = F.percentile("value", F.array(*(F.lit(x) for x in (a, 0.25, 0.75, 1 - a))))
    got = long.groupBy("name").agg(q.alias("q"), F.count("value").alias("used"), F.count_if(F.col("value").isNull()).alias("undefined"))
    return got.select("name", *(F.get("q", i).alias(n) for i, n in ((0, "low"), (3, "high"), (1, "q1"), (2, "q3"))), "used", "undefined")


def area(pos: dict[float, int], neg: dict[float, int]) -> float | None:
    """Mann-Whitney area of drawn counts by score."""
    below = won = 0
    for x in sorted(pos.keys() | neg.keys()):
        won += pos.get(x, 0) * (2 * below + neg.get(x, 0))
        below += neg.get(x, 0)
    n = sum(pos.values()) * below
    return won / (2 * n) if n else None


def least_cost(pos: dict[float, int], neg: dict[float, int], cost_ratio: float = 3.0) -> float | None:
    """The threshold (flag above it) of least cost over drawn counts by score; among equals the lowest; one candidate lies below all."""
    scores = sorted(x for x in pos.keys() | neg.keys() if pos.get(x, 0) + neg.get(x, 0))
    if not scores:
        return None
    missed, alarms = 0, sum(neg.values())
    best = (float(alarms), scores[0] - 1e-6)
    for x in scores:
        missed, alarms = missed + pos.get(x, 0), alarms - neg.get(x, 0)
        best = min(best, (cost_ratio * missed + alarms, x))
    return best[1]


def interval(values: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval by linear interpolation; undefined replicates are left out and counted."""
    a = (1 - level) / 2
    return values.agg(F.percentile("value", F.array(F.lit(a), F.lit(1 - a))).alias("q"), F.count("value").alias("used"), F.count_if(F.col("value").isNull()).alias("undefined")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "used", "undefined")


def verdict(point: Column, low: Column, high: Column, n: Column, least_n: int) -> Column:
    """Branches in order: too few rows, undefined, interval clear of 0 on a side, else inconclusive."""
    return F.when(n < least_n, "too_few").when(point.isNull() | low.isNull(), "undefined").when(low > 0, "worse").when(high < 0, "better").otherwise("inconclusive")


def f1_of(c: dict) -> float | None:
    d = 2 * c["tp"] + c["fp"] + c["fn"]
    return 2 * c["tp"] / d if d else None
