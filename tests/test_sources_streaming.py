"""Readers and sinks on small files; streams replayed against their batch twins."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from moderix.sources import readers, sinks
from moderix.streaming import jobs, repeats


def test_corpus_tsv_keeps_tabs_and_finds_faults(spark, tmp_path) -> None:
    p = tmp_path / "c.tsv"
    p.write_text('id\ttweet\tlabel\n1\tan "odd\tone\tOFF\n2\tx\n\n3\tb\tNOT\n3\tc\tNOT\n')
    rows = [tuple(r) for r in readers.corpus_tsv(spark, str(p)).orderBy("id", "text").collect()]
    assert rows == [("1", 'an "odd\tone', "OFF"), ("3", "b", "NOT"), ("3", "c", "NOT")]
    assert {r.fault for r in readers.corpus_faults(spark, str(p)).collect()} == {"short_line", "repeated_id"}
    with pytest.raises(readers.BadInput):
        readers.strict_corpus(spark, str(p))


def test_gold_and_guard(spark, tmp_path) -> None:
    g = tmp_path / "g.csv"
    g.write_text("1,OFF\n2,NOT\n")
    gold = readers.gold(spark, str(g))
    rows = spark.createDataFrame([("1",), ("9",)], "id string")
    with pytest.raises(readers.BadInput):
        readers.with_gold(rows, gold)
    assert readers.with_gold(rows.filter("id = '1'"), gold).first().gold == "OFF"
    with pytest.raises(readers.BadInput):
        readers.guarded_path("/x/testset.tsv")
    assert readers.guarded_path("/x/testset.tsv", spent=True)


def test_lists_and_sets(spark, tmp_path) -> None:
    w = tmp_path / "w.txt"
    w.write_text("# c\nISIT\nab # note\nabc\nabc\n\n")
    assert [r.root for r in readers.word_list(spark, str(w)).collect()] == ["ab # note", "abc", "ısıt"]
    assert [r.root for r in readers.gazetteer(spark, str(w)).collect()] == ["ısıt", "abc", "ab"]
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"primary": ["sen", "siz"], "primary_size": 3}))
    with pytest.raises(readers.BadInput):
        readers.token_sets(str(s))


def test_policy_is_checked() -> None:
    from moderix.operators.decision import POLICY

    assert readers.checked_policy(POLICY)
    with pytest.raises(readers.BadInput):
        readers.checked_policy(POLICY | {"guards_order": []})


def test_requests(spark) -> None:
    lines = spark.createDataFrame([('{"text":"a","thread":{"sender_id":"x"}}',), ('{"text":"a","thread":{"ts":1}}',), ("nope",), ('{"text":" "}',)], "value string")
    assert [r.problem for r in readers.raw_requests(lines).collect()] == [None, "bad_thread", "not_json", "no_text"]


def test_predictions_round_trip(spark, tmp_path) -> None:
    rows = spark.createDataFrame([("1", 'a "b"\nc', "OFF", "OFF", 0.5, "hit"), ("2", "x", "NOT", "OFF", 0.25, "free")], "row_id string, text string, gold string, pred string, confidence double, slice string")
    sinks.write_predictions(rows, str(tmp_path / "p"))
    back = readers.predictions(spark, str(tmp_path / "p"))
    assert back.filter("row_id = '1'").first().text == 'a "b"\nc'
    assert [r.row_id for r in readers.prediction_faults(back).collect()] == ["2"]


def test_digest_is_order_free(spark) -> None:
    a = spark.range(50).withColumn("x", F.col("id") % 7)
    one, two = (sinks.rows_digest(d, "id").first().sha256 for d in (a, a.orderBy(F.desc("id")).repartition(5)))
    assert one == two
    assert one != sinks.rows_digest(a.withColumn("x", F.lit(0)), "id").first().sha256


def test_repeat_stream_equals_batch(spark, tmp_path) -> None:
    rows = [(i, i % 3, i % 4, (i * 7919) % 1000, i % 2 == 0) for i in range(200)]
    schema = "event_id long, sender long, target long, received_us long, offensive boolean"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs_memory(spark, repeats.streamed_repeats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100), tmp_path)
    want = {r.event_id: r.repeats for r in repeats.repeats(batch, 100).collect()}
    assert out == want


def jobs_memory(spark, df, tmp_path) -> dict:  # noqa: ANN001
    q = df.writeStream.format("memory").queryName("repeats_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {r.event_id: r.repeats for r in spark.table("repeats_out").collect()}


def test_window_edges(spark) -> None:
    rows = spark.createDataFrame([(1, 1, 2, 0, True), (2, 1, 2, 10, True), (3, 1, 2, 10, False), (4, 5, 5, 10, True)], "event_id long, sender long, target long, received_us long, offensive boolean")
    got = {r.event_id: r.repeats for r in repeats.repeats(rows, 10).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}  # exactly as old as the window is out; a clean post sees, but does not add


def test_fan_out_of_a_stream(spark, tmp_path) -> None:
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    posts.write.parquet(str(tmp_path / "in"))

    def decide(df):  # noqa: ANN001, ANN202
        from moderix.operators.decision import SCORE

        return df.selectExpr("*", "1L created_us", f"cast(array(named_struct('code','A1','score',0.9,'source','m1@raw','span',null,'threshold',0.5,'fired',true)) as array<{SCORE}>) content", "named_struct('action','nudge') verdict", "false degraded")

    for _ in range(2):  # the second start has nothing new
        jobs.into_tables(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in")), decide, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/comments")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/scores")).first().offense_type == "A1"


def test_failures_stay_with_their_row(spark) -> None:
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, text string")

    def score(texts):  # noqa: ANN001, ANN202
        if "bad" in texts:
            raise RuntimeError
        return [float(len(t)) for t in texts]

    got = {r.id: (r.ok, r.score, r.error) for r in jobs.scored(rows, score).collect()}
    assert got == {1: (True, 1.0, None), 2: (False, None, "RuntimeError"), 3: (False, None, "TypeError")}
    assert jobs.reused(rows.unionByName(rows), lambda d: jobs.scored(d, lambda x: [1.0 for _ in x])).filter("score = 1").count() == 4


def test_limits_and_breaker(spark) -> None:
    rows = spark.createDataFrame([("x", i, i * 100_000) for i in range(5)], "ip string, id long, received_us long")
    assert [r.allowed for r in jobs.rate_limited(rows, 1.0, 2.0).orderBy("id").collect()] == [True, True, False, False, False]
    calls = spark.createDataFrame([("s", i, i * 10, ok) for i, ok in enumerate([False, False, True, True, True])], "service string, id long, at_us long, ok boolean")
    assert [r.state for r in jobs.breaker(calls, 2, 20).orderBy("id").collect()] == ["closed", "closed", "open", "half_open", "closed"]


def drained(spark, df, name: str, tmp_path, rows: int) -> list:  # noqa: ANN001
    """What a stream gives until it has given so many rows; timeouts keep such a stream running on."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    for _ in range(100):
        if spark.table(name).count() >= rows or q.awaitTermination(1):
            break
    q.stop()
    return spark.table(name).collect()


def test_limiter_and_breaker_streams_equal_their_replays(spark, tmp_path) -> None:
    rows = [(f"ip{i % 3}", i, i * 300_000 + (i % 5) * 7) for i in range(60)]
    schema = "ip string, id long, received_us long"
    for k in range(3):  # three micro-batches in order of time
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    got = {r.id: r.allowed for r in drained(spark, jobs.rate_limited_stream(stream, 1.0, 2.0), "limited", tmp_path, 60)}
    want = {r.id: r.allowed for r in jobs.rate_limited(spark.createDataFrame(rows, schema), 1.0, 2.0).collect()}
    assert len(got) == 60 and set(got.values()) == {True, False} and got == want
    calls = [(f"s{i % 2}", i, i * 10, (i * 7) % 5 > 1) for i in range(60)]
    schema = "service string, id long, at_us long, ok boolean"
    for k in range(3):
        spark.createDataFrame(calls[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"calls/part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls/part=*"))
    got = {r.id: (r.state, r.let) for r in drained(spark, jobs.breaker_stream(stream, 2, 25), "broken", tmp_path, 60)}
    assert got == {r.id: (r.state, r.let) for r in jobs.breaker(spark.createDataFrame(calls, schema), 2, 25).collect()}


def test_replays_of_many_batches_of_one_key(spark) -> None:
    """A key that spans Arrow batches keeps its state, null keys are a key, and no rows give none."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("ip"), "id", (F.col("id") * 400_000).alias("received_us"))
    got = jobs.rate_limited(rows, 1.0, 1.0)
    assert got.count() == 30_000
    buckets = {"hot": jobs.Bucket(1.0, 1.0), None: jobs.Bucket(1.0, 1.0)}
    want = {i: buckets["hot" if i % 3 else None].take(i * 400_000) for i in range(30_000)}
    assert {r.id: r.allowed for r in got.collect()} == want
    assert jobs.rate_limited(rows.limit(0), 1.0, 1.0).count() == 0


def test_cache_forgets_by_age_and_use(spark) -> None:
    calls = [(1, "a", 0, True), (2, "a", 5, True), (3, "b", 6, True), (4, "c", 7, True), (5, "a", 8, True), (6, "c", 9, True), (7, "c", 30, True), (8, "d", 31, False), (9, "d", 32, True)]
    rows = spark.createDataFrame([("m", *c) for c in calls], "artifact string, id long, key string, at_us long, ok boolean")
    got = {r.id: r.hit for r in jobs.cache_hits(rows, 2, 20).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False, 9: False}


def test_queue_turns_away_and_batches(spark) -> None:
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate([0, 1, 2, 3, 4, 500])], "service string, id long, at_us long")
    got = {r.id: (r.admitted, r.batch, r.start_us) for r in jobs.queued(rows, 2, 2, 10, 1, 100).collect()}
    assert got == {0: (True, 0, 1), 1: (True, 0, 1), 2: (True, 1, 101), 3: (True, 1, 101), 4: (False, None, None), 5: (True, 2, 510)}


def test_writer_prefers_analyses_and_drops(spark) -> None:
    kinds = ["metric", "metric", "metric", "analysis", "metric", "analysis"]
    rows = spark.createDataFrame([("w", i, k, i * 10) for i, k in enumerate(kinds)], "writer string, id long, kind string, at_us long")
    got = [(r.id, r.flush) for r in jobs.buffered(rows, 2, 3, 1000).collect()]
    assert got == [(2, -1), (3, 0), (0, 0), (1, 0), (5, 1), (4, 1)]


def test_callers_give_no_times(spark) -> None:
    assert "received_us" in jobs.stamped(spark.createDataFrame([("a",)], "text string")).columns
    with pytest.raises(ValueError):
        jobs.stamped(spark.createDataFrame([("a", 1)], "text string, received_us long"))


def test_held_out_corpus_is_spent_once(spark, tmp_path) -> None:
    p = tmp_path / "testset.tsv"
    p.write_text("id\ttweet\tlabel\n1\tx\tOFF\n")
    log = str(tmp_path / "opened")
    assert readers.held_out(spark, str(p), log, "final").count() == 1
    with pytest.raises(readers.BadInput):
        readers.held_out(spark, str(p), log, "final")
    assert readers.held_out(spark, str(p), log, "recount", again=True).count() == 1
    assert [r.purpose for r in spark.read.parquet(log).orderBy("opened_at").collect()] == ["final", "recount"]


def test_jsonl_names_the_line(spark, tmp_path) -> None:
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted(tuple(r) for r in readers.jsonl(spark, str(p), "a int, b string").collect()) == [(1, "x"), (2, None)]
    p.write_text('{"a": 1}\n{"a": 2}\n{"a": \n')
    with pytest.raises(readers.BadInput, match="line 3"):
        readers.jsonl(spark, str(p), "a int, b string")


def test_predictions_are_those_of_the_split(spark) -> None:
    from moderix.operators import evaluation as ev

    rows = spark.createDataFrame([("1", "OFF", 0.5), ("2", "NOT", 0.25)], "row_id string, pred string, confidence double")
    mark = ev.fingerprint(rows).first().sha256
    assert readers.matched_predictions(rows, rows, mark).count() == 2
    for bad, ids in ((rows.limit(1), rows), (rows, rows.limit(1)), (rows.withColumn("pred", F.lit("OFF")), rows)):
        with pytest.raises(readers.BadInput):
            readers.matched_predictions(bad, ids, mark)


def test_a_batch_counts_when_it_is_whole(spark, tmp_path) -> None:
    from moderix.operators.decision import SCORE

    posts = spark.createDataFrame([(1, "a")], "id long, text string").selectExpr("*", "1L created_us", f"cast(array() as array<{SCORE}>) content", "named_struct('action','clean') verdict", "false degraded")
    base = str(tmp_path)
    for n in (0, 1, 1):
        sinks.write_batch(posts, n, base)
    sinks.fan_out(posts)[0].write.parquet(f"{base}/comments/batch=2")  # a batch that broke off
    assert sinks.committed(spark, base, "comments").count() == 2 and spark.read.parquet(f"{base}/comments").count() == 3


def test_migrations(spark) -> None:
    spark.sql("create database if not exists moved")
    try:
        assert not any(sinks.migration_status(spark, "moved").values())
        assert sinks.migrate(spark, "moved") == list(sinks.DDL) and sinks.migrate(spark, "moved") == []
        assert all(sinks.migration_status(spark, "moved").values())
        assert sinks.unmigrate(spark, "moved") == list(reversed(sinks.DDL))
    finally:
        spark.sql("drop database if exists moved cascade")
