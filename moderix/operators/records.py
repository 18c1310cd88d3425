"""Operators on analysis records, modules, labels and fixtures: projections, states, traps, diffs, gates, segments."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderix.operators.evaluation import seeded

RECORD = "verdict string, content array<struct<code:string,score:double,source:string,fired:boolean>>, guards array<struct<code:string,active:boolean>>, signals struct<pipeline:struct<degraded:array<string>>, decision:struct<binary_offensive:struct<fired:boolean>>>"


def summary(result_json: Column, actions: list[str]) -> Column:
    """What the store keeps of a record: verdict (an unknown one is refused as null with ``valid`` false), fired codes and active guards in
    order, and whether the judgement is incomplete; without a pipeline signal it counts as incomplete."""
    r = F.from_json(result_json, RECORD)
    fired = F.transform(F.filter(r["content"], lambda s: F.coalesce(s["fired"], F.lit(False))), lambda s: s["code"])
    guards = F.transform(F.filter(r["guards"], lambda g: F.coalesce(g["active"], F.lit(False))), lambda g: g["code"])
    known = r["verdict"].isNull() | r["verdict"].isin(actions)
    return F.struct(F.coalesce(known, F.lit(False)).alias("valid"), F.when(known, r["verdict"]).alias("verdict"), fired.alias("fired_types"), guards.alias("guards_active"), F.coalesce(F.size(r["signals"]["pipeline"]["degraded"]) > 0, F.lit(True)).alias("degraded"), F.coalesce(r["signals"]["decision"]["binary_offensive"]["fired"], F.lit(False)).alias("binary"))


def public(signals: Column) -> Column:
    """A signal map without its private keys."""
    return F.map_filter(signals, lambda k, v: ~F.startswith(k, F.lit("_")))


def fired_categories(content: Column, binary: Column) -> Column:
    """Fired codes by score, highest first, equal ones by code, and the binary channel last."""
    fired = F.filter(content, lambda s: F.coalesce(s["fired"], F.lit(False)))
    ranked = F.transform(F.array_sort(F.transform(fired, lambda s: F.struct((-s["score"]).alias("s"), s["code"].alias("c")))), lambda x: x["c"])
    return F.concat(ranked, F.when(F.coalesce(binary, F.lit(False)), F.array(F.lit("binary_offensive"))).otherwise(F.array().cast("array<string>")))


def module_state(times: Column, failed: Column, stubs: Column, name: str) -> Column:
    return F.when(F.array_contains(failed, name), "failed").when(F.array_contains(stubs, name), "stub").when(F.map_contains_key(times, name), "ran").otherwise("absent")


def trap_problems(rows: DataFrame) -> DataFrame:
    """(id, problem, code) of rows (id, codes, must, must_not): codes missing or forbidden; * in must_not forbids any."""
    missing = F.transform(F.array_except("must", "codes"), lambda c: F.struct(F.lit("missing").alias("problem"), c.alias("code")))
    named = F.transform(F.when(F.array_contains("must_not", "*"), F.col("codes")).otherwise(F.array_intersect("codes", "must_not")), lambda c: F.struct(F.lit("forbidden").alias("problem"), c.alias("code")))
    return rows.select("id", F.explode(F.concat(missing, F.array_distinct(named))).alias("x")).select("id", "x.*")


def expectation(kind: str, got: Column, want: Column) -> Column:
    """A scenario's expectation of a set of codes."""
    tests = {
        "exact": (F.size(F.array_except(got, want)) == 0) & (F.size(F.array_except(want, got)) == 0), "include": F.size(F.array_except(want, got)) == 0,
        "any": F.arrays_overlap(got, want), "exclude": ~F.coalesce(F.arrays_overlap(got, want), F.lit(False)),
    }
    return F.coalesce(tests[kind], F.lit(False))


def verdict_at_least(got: Column, want: Column, severity: list[str]) -> Column:
    place = F.create_map(*(F.lit(x) for i, s in enumerate(severity) for x in (s, i)))
    return F.try_element_at(place, got) <= F.try_element_at(place, want)


def routed(confidence: Column, threshold: float, score: Column) -> Column:
    """Resolved by the machine, or deferred to a person without showing the score."""
    auto = confidence >= threshold
    return F.struct(F.when(auto, "AUTO-RESOLVE").otherwise("DEFER").alias("route"), F.when(auto, score).alias("score"))


def label_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of (row_id, label, rules array<string>) from one labelling to another, with the rules that came and went."""
    o = old.select("row_id", F.col("label").alias("was"), F.col("rules").alias("old_rules"))
    n = new.select("row_id", F.col("label").alias("now"), F.col("rules").alias("new_rules"))
    both = o.join(n, "row_id", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    none = F.array().cast("array<string>")
    a, b = F.coalesce("old_rules", none), F.coalesce("new_rules", none)
    return both.select("row_id", "was", "now", F.array_join(F.array_sort(F.array_except(b, a)), " ").alias("came"), F.array_join(F.array_sort(F.array_except(a, b)), " ").alias("went"))


def pseudo_label(valid_hit: Column, positive: Column) -> Column:
    """1 for a valid hit of a positive root, 0 without a hit, null for any other hit."""
    return F.when(valid_hit & positive, 1).when(~valid_hit, 0)


def gate(observed: DataFrame, expected: dict[str, float], places: int = 6) -> DataFrame:
    """(figure, expected, observed) of a one-row result that differs from recorded figures."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("figure"), F.lit(float(v)).alias("expected"), F.col(k).cast("double").alias("observed")) for k, v in expected.items())))
    return observed.select(pairs.alias("x")).select("x.*").filter(~F.round("expected", places).eqNullSafe(F.round("observed", places)))


def partition_faults(parts: dict[str, DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """(key, fault): in more than one part, or in none, or not in the whole."""
    tagged = None
    for name, d in parts.items():
        one = d.select(key).distinct().withColumn("part", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.groupBy(key).agg(F.count("*").alias("k"))
    all_keys = whole.select(key).distinct().withColumn("known", F.lit(True))
    both = counts.join(all_keys, key, "full_outer")
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "overlap")
    return both.select(key, fault.alias("fault")).filter("fault is not null")


def segments(text: Column, spans: Column) -> Column:
    """A text cut at the ends of its spans: (start, end, keys of the spans over it), whole text covered, empty pieces left out."""
    n = F.length(text)
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))))
    pieces = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.transform(pieces, lambda p: F.struct(p["start"], p["end"], F.transform(F.filter(spans, lambda s: (s["start"] <= p["start"]) & (p["end"] <= s["end"])), lambda s: s["key"]).alias("keys")))


def changes(patterns: Column, offsets: Column) -> Column:
    """For each repair the span of its result in the normalised text: the characters whose originals lie in the repair's span."""
    return F.transform(patterns, lambda p: F.struct(p["code"].alias("code"), p["start"].alias("start"), p["end"].alias("end"), F.size(F.filter(offsets, lambda o: o < p["start"])).alias("to_start"), F.size(F.filter(offsets, lambda o: o < p["end"])).alias("to_end")))


def display(content: Column, times: Column, margin_codes: Column) -> Column:
    """Numbers for a reader: categories evaluated, fired, and the closest distance to a threshold among those that did not fire."""
    gaps = F.transform(F.filter(content, lambda s: ~F.coalesce(s["fired"], F.lit(False)) & s["threshold"].isNotNull()), lambda s: s["threshold"] - s["score"])
    return F.struct(F.size(F.array_distinct(F.transform(content, lambda s: s["code"]))).alias("evaluated"), F.size(F.filter(content, lambda s: F.coalesce(s["fired"], F.lit(False)))).alias("fired"), F.array_min(gaps).alias("closest"), F.size(F.map_keys(times)).alias("modules"), F.size(margin_codes).alias("patterns"))


def damaged(before: Column, after: Column) -> Column:
    """Did a repair change the tokens of a text, case aside?"""
    from moderix.functions.text import tr_lower

    return F.split(tr_lower(before), r"\s+") != F.split(tr_lower(after), r"\s+")


def capability(codes: DataFrame, thresholds: DataFrame, degraded: list[str]) -> DataFrame:
    """(code, module, threshold, state) of every code that some module can produce."""
    state = F.when(F.col("module").isNull(), "not_produced").when(F.col("module").isin(degraded), "degraded").otherwise("active")
    return codes.join(thresholds, "code", "left").select("code", "module", "threshold", state.alias("state"))


def matched_outcomes(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """Requests with their answers, where an id may repeat: the n-th answer of an id belongs to its n-th request."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("id").orderBy("place"))
    return asked.withColumn("n", n).join(answered.withColumn("n", n).withColumnRenamed("place", "answer_place"), ["id", "n"], "left")


def random_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, by least seeded hash, in that order: a draw that any run can repeat."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def out_of_fold(parts: list[DataFrame], whole: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions of all folds, if they cover every row once; else the rows that do not fit are an error."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    bad = merged.select(key).exceptAll(whole.select(key)).unionAll(whole.select(key).exceptAll(merged.select(key)))
    if not bad.isEmpty():
        raise ValueError("the folds do not cover the rows once")
    return merged


def canonical(x: object) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def artifact_hash(policy: dict, modules: list[tuple[str, str]]) -> str:
    """SHA-256 of the policy and the modules' versions."""
    return hashlib.sha256((canonical(policy) + "".join(f"|{n}:{v}" for n, v in modules)).encode()).hexdigest()


def renamed_equal(old: dict, new: dict, renames: dict[str, str], free: frozenset[str]) -> list[str]:
    """Paths at which new is not old with its keys renamed, but for the keys that are free to change."""
    out: list[str] = []

    def walk(a: object, b: object, at: str) -> None:
        if isinstance(a, dict) and isinstance(b, dict):
            a = {renames.get(k, k): v for k, v in a.items()}
            for k in sorted(a.keys() | b.keys()):
                if k not in free:
                    walk(a.get(k), b.get(k), f"{at}.{k}" if at else k)
        elif a != b:
            out.append(at)

    walk(old, new, "")
    return out


# -- generators ---------------------------------------------------------------------------------------------------

#: Letters and their look-alikes for generated disguises.
DISGUISE = ("aeopcx", "аеорсх")


def disguised(word: Column, key: Column, seed: int) -> Column:
    """struct(operator, text): a seeded disguise of a word; the same key and seed give the same."""
    pick = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(5)).cast("int")
    spaced = F.array_join(F.split(word, ""), " ")
    dotted = F.array_join(F.split(word, ""), ".")
    leet = F.translate(word, "aeios", "43105")
    twins = F.translate(word, *DISGUISE)
    longer = F.regexp_replace(word, r"([aeıioöuü])", "$1$1$1")
    forms = F.array(spaced, dotted, leet, twins, longer)
    names = F.array(*(F.lit(x) for x in ("SPACED", "PUNCT_SPLIT", "LEET", "HOMOGLYPH", "REPEAT")))
    return F.struct(F.element_at(names, pick + 1).alias("operator"), F.element_at(forms, pick + 1).alias("text"))


def augmented(rows: DataFrame, hits: Column, mask: str, seed: int) -> DataFrame:
    """Rows whose hit words are masked (a seeded half) or doubled: (row_id, operator, text, label), the label kept."""
    half = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(2)) == 0
    text = F.array_join(F.transform(F.split("text", " "), lambda w: F.when(F.array_contains(hits, w), F.when(half, F.lit(mask)).otherwise(F.concat(w, F.lit(" "), w))).otherwise(w)), " ")
    changed = rows.withColumn("new", text).filter("new <> text")
    return changed.select("row_id", F.when(half, "mask").otherwise("double").alias("operator"), F.col("new").alias("text"), "label")
