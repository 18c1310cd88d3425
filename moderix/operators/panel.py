"""Panel operators: predicates, latest-action joins, pages, counts and time buckets over the store's relations.

Every function takes DataFrames and the time it is asked at; none reads a clock. Times are microseconds.
"""

from __future__ import annotations

import base64
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detected(types: str = "fired_types", binary: str = "binary_fired") -> Column:
    """Some category fired, or the binary channel did; an undecided channel is no detection."""
    return (F.size(types) > 0) | F.coalesce(F.col(binary), F.lit(False))


def status(latest: Column, verdict: Column) -> Column:
    """The queue state: the latest moderator action wins over the verdict; order matters."""
    return (
        F.when(latest.isin("approve", "hide", "remove"), "reviewed").when(latest.isin("queue", "false_positive"), "pending")
        .when(verdict.isNull() | verdict.isin("review", "escalate"), "pending").when(verdict.isin("block", "nudge"), "auto").otherwise("none")
    )


def like_literal(x: Column, needle: str) -> Column:
    """Case-insensitive substring search in which %, _ and \\ stand for themselves."""
    return F.contains(F.lower(x), F.lit(needle.lower()))


def before(t: Column, i: Column, cursor: tuple[int, int] | None) -> Column:
    """Keyset predicate of a descending page: (t, i) is below the cursor."""
    return F.lit(True) if cursor is None else F.struct(t, i) < F.struct(F.lit(cursor[0]).cast("long"), F.lit(cursor[1]).cast("long"))


def encode_cursor(t: int, i: int | str) -> str:
    return base64.urlsafe_b64encode(f"{t}|{i}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, str]:
    try:
        t, i = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().split("|", 1)
        return int(t), i
    except ValueError as e:
        raise ValueError("bad cursor") from e


def latest_actions(actions: DataFrame) -> DataFrame:
    """(comment_id, latest, latest_us): the newest action of each comment, ties by id; one aggregation, no ranking sort."""
    top = F.max_by(F.struct("action", "created_us"), F.struct("created_us", "id"))
    return actions.groupBy("comment_id").agg(top.alias("x")).select("comment_id", F.col("x.action").alias("latest"), F.col("x.created_us").alias("latest_us"))


def items(comments: DataFrame, sessions: DataFrame, decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Comments with session, decision, latest action and status."""
    s = sessions.withColumnRenamed("id", "session_id")
    rows = comments.join(s, "session_id").join(decisions.withColumnRenamed("comment_id", "id"), "id")
    rows = rows.join(latest_actions(actions).withColumnRenamed("comment_id", "id"), "id", "left")
    return rows.withColumn("status", status(F.col("latest"), F.col("final_action"))).withColumn("detected", detected())


def matching(rows: DataFrame, *, verdict: str | None = None, code: str | None = None, state: str | None = None, only_detected: bool = False, q: str | None = None, since: int | None = None, until: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Only the filters that are set; ``code`` may be binary_offensive."""
    tests: list[Column] = []
    if verdict:
        tests.append(F.col("final_action") == verdict)
    if code:
        tests.append(F.coalesce(F.col("binary_fired"), F.lit(False)) if code == "binary_offensive" else F.array_contains("fired_types", code))
    if state:
        tests.append(F.col("status") == state)
    if only_detected:
        tests.append(F.col("detected"))
    if q:
        tests.append(like_literal(F.col("raw_text"), q) | like_literal(F.col("nickname"), q))
    if since is not None:
        tests.append(F.col("created_us") >= since)
    if until is not None:
        tests.append(F.col("created_us") < until)
    if ids is not None:
        tests.append(F.col("id").isin(ids))
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def page(rows: DataFrame, n: int, cursor: tuple[int, int] | None = None) -> DataFrame:
    """The next n + 1 rows, newest first; the last tells whether there is another page."""
    return rows.filter(before(F.col("created_us"), F.col("id"), cursor)).orderBy(F.desc("created_us"), F.desc("id")).limit(n + 1)


def flagged(rows: DataFrame) -> DataFrame:
    """All that is not clean; undecided rows stay."""
    return rows.filter(~F.col("final_action").eqNullSafe("clean"))


def reasons(page_rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, reasons): fired codes with scores of the page's comments, best first, codes in order among equals."""
    fired = scores.filter("fired").join(page_rows.select(F.col("id").alias("comment_id")), "comment_id", "left_semi")
    best = fired.groupBy("comment_id", "offense_type").agg(F.max("score").alias("score"))
    listed = best.groupBy("comment_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("offense_type").alias("c")))).alias("l"))
    return listed.select(F.col("comment_id").alias("id"), F.transform("l", lambda x: F.concat_ws(":", x["c"], F.format_string("%.4f", -x["s"]))).alias("reasons"))


def timeline(actions: DataFrame, comments: DataFrame, sessions: DataFrame, decisions: DataFrame, kind: str = "") -> DataFrame:
    """Moderator and system events under one key: m and the padded id, s and the comment's id."""
    c = comments.select(F.col("id").alias("comment_id"), "session_id", F.col("created_us").alias("commented_us"))
    d = decisions.select("comment_id", "final_action", "fired_types")
    actor = sessions.select(F.col("id").alias("actor_id"), F.col("nickname").alias("actor"))
    author = sessions.select(F.col("id").alias("session_id"), F.col("nickname").alias("author"))
    out = []
    if kind in ("", "moderator"):
        m = actions.select("comment_id", F.col("session_id").alias("actor_id"), "id", "action", "created_us").join(c, "comment_id").join(d, "comment_id").join(author, "session_id").join(actor, "actor_id", "left")
        out.append(m.select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 19, "0")).alias("key"), F.lit("moderator").alias("kind"), "comment_id", "action", "actor", "author", "created_us"))
    if kind in ("", "system"):
        s = flagged(d).join(c, "comment_id").join(author, "session_id")
        out.append(s.select(F.concat(F.lit("s"), F.col("comment_id").cast("string")).alias("key"), F.lit("system").alias("kind"), "comment_id", F.col("final_action").alias("action"), F.lit(None).cast("string").alias("actor"), "author", F.col("commented_us").alias("created_us")))
    return reduce(DataFrame.unionByName, out)


def previous(rows: DataFrame, n: int) -> DataFrame:
    """For every comment its up to n earlier comments of the same session, newest first: (id, place, previous_id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("created_us", "id")
    lags = F.array(*(F.struct(F.lit(k).alias("place"), F.lag("id", k).over(w).alias("previous_id")) for k in range(1, n + 1)))
    return rows.select("id", lags.alias("lags")).select("id", F.explode("lags").alias("x")).select("id", "x.place", "x.previous_id").filter("previous_id is not null")


def add_actions(ids: DataFrame, comments: DataFrame, sessions: DataFrame, action: str, session: int, us: int) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, missing ids): an unknown session becomes null, an unknown comment is reported."""
    known = comments.select(F.col("id").alias("comment_id"))
    who = sessions.filter(F.col("id") == session).select(F.col("id").alias("session_id"))
    rows = ids.join(known, "comment_id", "left_semi").join(who, F.lit(True), "left")
    return rows.select("comment_id", F.lit(action).alias("action"), "session_id", F.lit(us).alias("created_us")), ids.join(known, "comment_id", "left_anti")


def bucket(t: Column, start: int, width: int) -> Column:
    """Index of a tumbling bucket; exact for times before the start as well."""
    return F.floor((t - start) / width).cast("long")


def count_series(rows: DataFrame, codes: list[str], start: int, width: int, n: int, code_col: str = "offense_type") -> DataFrame:
    """(code, bucket, n): distinct comments of each code and bucket, zeros filled in."""
    spark = rows.sparkSession
    got = rows.filter((F.col("created_us") >= start) & (F.col("created_us") < start + n * width))
    got = got.groupBy(F.col(code_col).alias("code"), bucket(F.col("created_us"), start, width).alias("bucket")).agg(F.count_distinct("comment_id").alias("n"))
    grid = spark.createDataFrame([(c, b) for c in codes for b in range(n)], "code string, bucket long")
    return grid.join(got, ["code", "bucket"], "left").select("code", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def change_pct(now: Column, prev: Column) -> Column:
    """Per cent to one place, halves away from zero; null where there is nothing to compare with."""
    return F.when(prev != 0, F.round((now - prev) / prev * 1000) / 10)


def share_pct(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 1000) / 10)


def request_series(metrics: DataFrame, start: int, width: int, n: int) -> DataFrame:
    """Per bucket: requests, server errors, exact linear p50 and p95; a bucket without requests has null percentiles."""
    got = metrics.filter((F.col("created_us") >= start) & (F.col("created_us") < start + n * width))
    got = got.groupBy(bucket(F.col("created_us"), start, width).alias("bucket")).agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    grid = metrics.sparkSession.range(n).withColumnRenamed("id", "bucket")
    return grid.join(got, "bucket", "left").select("bucket", F.coalesce("requests", F.lit(0)).cast("long").alias("requests"), F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))
