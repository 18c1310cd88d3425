"""The decision layer: scores, guards, target and signals of a post become codes that fire and a verdict.

A post is one row with ``content`` (array of scores), ``guards``, ``target`` and ``form``; rules are higher-order functions on these arrays, so
deciding needs no shuffle. Policy comes as a plain dict (``POLICY``), never as literals in the rules. Fired flags have three values:
null is undecided, and never counts as false.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The policy's thresholds and actions; nudge, block and so on are applied as given.
POLICY: dict = {
    "form_min_confidence": 0.5,
    "target_min_confidence": 0.5,
    "by_target": {"none": "A1", "individual": "A2", "group": "A3", "non_human": "A1"},
    "categories": {
        "A1": (0.5, "nudge"), "A2": (0.5, "block"), "A3": (0.5, "block"), "A4": (0.5, "review"), "B1": (0.5, "nudge"), "B2": (0.5, "escalate"), "B3": (0.5, "nudge"), "B4": (0.5, "escalate"),
        "B5": (0.5, "block"), "C1": (0.5, "nudge"), "C2": (0.5, "nudge"), "C3": (0.5, "review"), "C4": (0.5, "escalate"), "C5": (0.5, "nudge"), "D1": (0.5, "nudge"),
    },
    "binary": {"threshold": 0.320188, "action": "review", "low": 0.30, "high": 0.70, "above": "block", "below": "nudge"},
    "guards": {"SUBSTRING_COLLISION": (0.5, ["A"]), "HOMONYM": (0.5, ["A", "B1"]), "NON_HUMAN_TARGET": (0.5, ["A1", "A2", "A3", "B1"])},
    "guards_order": ["SUBSTRING_COLLISION", "HOMONYM", "NON_HUMAN_TARGET"],
    "severity": ["block", "escalate", "review", "nudge", "clean"],
    "fast_path_margin": 0.3,
}

SPAN = "struct<start:int,end:int>"
SCORE = f"struct<code:string,score:double,source:string,span:{SPAN},threshold:double,fired:boolean>"
GUARD = f"struct<code:string,score:double,source:string,evidence:string,span:{SPAN},threshold:double,active:boolean,suppressed:array<string>>"


def module_of(source: Column) -> Column:
    return F.substring_index(source, "@", 1)


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def score(code: Column, value: Column, source: Column, span: Column, threshold: Column, fired: Column) -> Column:
    return F.struct(code.alias("code"), value.alias("score"), source.alias("source"), span.alias("span"), threshold.alias("threshold"), fired.alias("fired"))


def reset(content: Column) -> Column:
    """Fields that only this layer may fill are cleared first, so deciding twice decides the same."""
    return F.transform(content, lambda s: score(s["code"], s["score"], s["source"], s["span"], F.lit(None).cast("double"), F.lit(None).cast("boolean")))


def family_a(policy: dict, kind: Column, confidence: Column) -> Column:
    """The code of A1 to A3 for this post: by its target, if that is certain enough, else by none."""
    used = F.when(F.coalesce(confidence >= policy["target_min_confidence"], F.lit(False)), F.coalesce(kind, F.lit("none"))).otherwise("none")
    return _map(policy["by_target"])[used]


def recoded(content: Column, code: Column) -> Column:
    a = lambda s: F.when(s["code"].isin("A1", "A2", "A3"), code).otherwise(s["code"])
    return F.transform(content, lambda s: score(a(s), s["score"], s["source"], s["span"], s["threshold"], s["fired"]))


def threshold_of(scalar: Column, when_true: Column | None, when_false: Column | None, signal: Column | None) -> Column:
    """A signal-conditioned threshold: its branch by a boolean signal, the scalar if there is none."""
    if signal is None:
        return scalar
    return F.when(signal, when_true).when(~signal, when_false).otherwise(scalar)


def thresholded(policy: dict, content: Column) -> Column:
    """Fires at the threshold; a code without one never fires."""
    t = _map({k: v[0] for k, v in policy["categories"].items()})

    def one(s: Column) -> Column:
        bound = F.try_element_at(t, s["code"])
        return score(s["code"], s["score"], s["source"], s["span"], bound, F.coalesce(s["score"] >= bound, F.lit(False)))

    return F.transform(F.filter(content, lambda s: s["code"] != "CLEAN"), one)


def binary_fired(policy: dict, channels: list[Column]) -> Column:
    """Any channel at the threshold; null if no channel has a score."""
    t = policy["binary"]["threshold"]
    return F.when(reduce(lambda a, b: a | b, (c.isNotNull() for c in channels)), reduce(lambda a, b: a | b, (F.coalesce(c >= t, F.lit(False)) for c in channels)))


def binary_action(policy: dict, best: Column) -> Column:
    """Beyond the review band the score decides without a person; only an action that asks for one is replaced."""
    b = policy["binary"]
    if b["action"] not in ("review", "escalate"):
        return F.lit(b["action"])
    return F.when(best > b["high"], b["above"]).when(best < b["low"], b["below"]).otherwise(b["action"])


def active_guards(policy: dict, guards: Column) -> Column:
    t = _map({k: v[0] for k, v in policy["guards"].items()})
    return F.filter(guards, lambda g: F.coalesce(g["score"] >= F.try_element_at(t, g["code"]), F.lit(False)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def covers(policy: dict, guard_code: str, code: Column) -> Column:
    listed = policy["guards"][guard_code][1]
    return code.isin(listed) | F.substring(code, 1, 1).isin([x for x in listed if len(x) == 1])


def guarded(policy: dict, content: Column, guards: Column, emits_spans: Column) -> Column:
    """The guards in their order: an active one clears what it covers from its own module and place. Where a span is missing only
    modules that have none fall back to the whole post. emits_spans: map of module to boolean."""
    active = active_guards(policy, guards)
    for name in policy["guards_order"]:
        content = F.transform(content, _clearing(policy, name, active, emits_spans))
    return content


def _clearing(policy: dict, name: str, active: Column, emits_spans: Column) -> Callable[[Column], Column]:
    """What guards of one name do to a score."""

    def one(s: Column) -> Column:
        def hits(g: Column) -> Column:
            module = module_of(g["source"])
            placed = g["span"].isNotNull() & s["span"].isNotNull()
            spans = F.coalesce(F.try_element_at(emits_spans, module), F.lit(False))
            return (g["code"] == name) & (g["source"] != "") & (module == module_of(s["source"])) & F.when(placed, overlap(g["span"], s["span"])).otherwise(~spans)

        gone = F.coalesce(s["fired"], F.lit(False)) & covers(policy, name, s["code"]) & F.exists(active, hits)
        return score(s["code"], s["score"], s["source"], s["span"], s["threshold"], F.when(gone, False).otherwise(s["fired"]))

    return one


def fused(content: Column) -> Column:
    """One score a code, in order of first appearance: the highest of the fired ones, or if none fired of all; the earlier of equals."""
    codes = F.array_distinct(F.transform(content, lambda s: s["code"]))

    def one(code: Column) -> Column:
        own = F.filter(content, lambda s: s["code"] == code)
        fired = F.filter(own, lambda s: F.coalesce(s["fired"], F.lit(False)))
        pool = F.when(F.size(fired) > 0, fired).otherwise(own)
        best = F.array_max(F.transform(pool, lambda s: s["score"]))
        return F.filter(pool, lambda s: s["score"] == best)[0]

    return F.transform(codes, one)


def fused_rows(scores: DataFrame, key: str = "comment_id") -> DataFrame:
    """The same fusion on exploded rows (key, code, channel, score, fired): the raw channel first among equals."""
    rank = F.struct(F.coalesce("fired", F.lit(False)), F.col("score"), (F.col("channel") == "raw"))
    return scores.groupBy(key, "code").agg(F.max_by(F.struct("score", "channel"), rank).alias("b"), F.bool_or("fired").alias("fired")).select(key, "code", "b.score", "b.channel", "fired")


def active_form(policy: dict, patterns: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(patterns, lambda p: p["confidence"] >= policy["form_min_confidence"]), lambda p: p["code"]))


def post_offensive(content: Column, binary: Column) -> Column:
    return F.exists(content, lambda s: F.coalesce(s["fired"], F.lit(False))) | F.coalesce(binary, F.lit(False))


def verdict(policy: dict, content: Column, binary: Column, best_binary: Column, thread: Column, thread_action: str, degraded: Column) -> Column:
    """struct(action, driver): the most severe of the fired codes, the binary channel and the thread; earlier and higher-scored ones
    win among equals. A post that would be clean but was judged in part goes to review."""
    place = _map({a: i for i, a in enumerate(policy["severity"])})
    action = _map({k: v[1] for k, v in policy["categories"].items()})
    fired = F.filter(content, lambda s: F.coalesce(s["fired"], F.lit(False)))
    offers = F.transform(fired, lambda s: F.struct(place[action[s["code"]]].alias("at"), F.lit(0).alias("kind"), (-s["score"]).alias("by"), s["code"].alias("driver")))

    def more(on: Column, a: Column, kind: int, name: str) -> Column:
        return F.when(F.coalesce(on, F.lit(False)), F.array(F.struct(place[a].alias("at"), F.lit(kind).alias("kind"), F.lit(0.0).alias("by"), F.lit(name).alias("driver")))).otherwise(F.array().cast("array<struct<at:int,kind:int,by:double,driver:string>>"))

    every = F.concat(offers, more(binary, binary_action(policy, best_binary), 1, "binary_offensive"), more(thread, F.lit(thread_action), 2, "thread"))
    top = F.array_min(F.filter(every, lambda o: o["at"] < policy["severity"].index("clean")))
    names = F.array(*(F.lit(a) for a in policy["severity"]))
    return (
        F.when(top.isNotNull(), F.struct(F.element_at(names, top["at"] + 1).alias("action"), top["driver"].alias("driver")))
        .when(F.coalesce(degraded, F.lit(False)), F.struct(F.lit("review").alias("action"), F.lit("degraded").alias("driver")))
        .otherwise(F.struct(F.lit("clean").alias("action"), F.lit(None).cast("string").alias("driver")))
    )


def decided(posts: DataFrame, policy: dict = POLICY, emits_spans: dict[str, bool] | None = None) -> DataFrame:
    """Posts (content, guards, target_type, target_confidence, raw_score, degraded) with content, binary, offensive and verdict filled."""
    spans = _map(emits_spans or {"m1_lexicon": True, "m6_target": True})
    code = family_a(policy, F.col("target_type"), F.col("target_confidence"))
    # each step a column of its own: later steps refer to it and do not repeat its expression
    posts = posts.withColumn("content", thresholded(policy, recoded(reset(F.col("content")), code)))
    posts = posts.withColumn("content", guarded(policy, F.col("content"), F.col("guards"), spans))
    posts = posts.withColumn("content", fused(F.col("content"))).withColumn("binary", binary_fired(policy, [F.col("raw_score")]))
    posts = posts.withColumn("offensive", post_offensive(F.col("content"), F.col("binary")))
    v = verdict(policy, F.col("content"), F.col("binary"), F.col("raw_score"), F.lit(False), "escalate", F.col("degraded"))
    return posts.withColumn("verdict", v)


def valid_scores(content: Column, text: Column) -> Column:
    """Only scores that are finite and in [0, 1], with spans inside the text; the rest is dropped, which degrades the module."""
    return F.filter(content, lambda s: s["score"].isNotNull() & ~F.isnan(s["score"]) & s["score"].between(0, 1) & (s["span"].isNull() | ((s["span"]["start"] >= 0) & (s["span"]["start"] < s["span"]["end"]) & (s["span"]["end"] <= F.length(text)))))


def outermost(spans: Column) -> Column:
    """Spans that lie in no other one."""
    return F.filter(spans, lambda h: ~F.exists(spans, lambda o: (o["start"] <= h["start"]) & (h["end"] <= o["end"]) & (o != h)))


def first_come(spans: Column) -> Column:
    """Each span, in order, that overlaps none taken before it."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(spans, empty, lambda acc, s: F.when(F.exists(acc, lambda t: overlap(t, s)), acc).otherwise(F.concat(acc, F.array(s))))


def fast_path(policy: dict, content: Column, guards: Column) -> Column:
    """Some code clears its threshold by the margin and no guard is active."""
    t = _map({k: v[0] for k, v in policy["categories"].items()})
    sure = F.exists(content, lambda s: F.coalesce(s["score"] >= F.try_element_at(t, s["code"]) + policy["fast_path_margin"], F.lit(False)))
    return sure & (F.size(active_guards(policy, guards)) == 0)


def explanation(action: Column, driver: Column) -> Column:
    """One sentence for the verdict."""
    return F.when(action == "clean", F.lit("No offensive category passed its threshold.")).when(driver == "degraded", F.lit("The judgement is incomplete; the content goes to review.")).when(driver == "binary_offensive", F.concat(F.lit("The general offensiveness score passed its threshold: "), action, F.lit("."))).otherwise(F.concat(F.lit("Category "), driver, F.lit(" fired: "), action, F.lit(".")))
