"""Streaming jobs: decided posts into tables, rolling latencies, rate limits, a circuit breaker, result reuse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def in_time(rows: DataFrame, now_us: int) -> DataFrame:
    """Requests whose deadline has not passed, before any model sees them."""
    return rows.filter(F.col("deadline_us").isNull() | (F.col("deadline_us") > now_us))


def scored(rows: DataFrame, score: Callable[[list[str]], list[float]], key: str = "id", most: int = 64) -> DataFrame:
    """(key, ok, score, error): a model in batches of at most ``most``; a batch that fails is tried one by one, so that
    one bad text costs only itself. Null texts are an error of their own."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(frames: Iterator) -> Iterator:  # noqa: ANN401
        import pandas as pd

        def one(text: str | None) -> tuple:
            try:
                return True, float(score([text])[0]), None
            except Exception as e:  # noqa: BLE001
                return False, None, type(e).__name__

        for f in frames:
            out: list[tuple] = []
            for at in range(0, len(f), most):
                texts = f["text"].iloc[at : at + most].tolist()
                try:
                    if any(t is None for t in texts):
                        raise ValueError("null")
                    out += [(True, float(s), None) for s in score(texts)]
                except Exception:  # noqa: BLE001
                    out += [one(t) for t in texts]
            yield pd.DataFrame({key: f[key], "ok": [x[0] for x in out], "score": pd.Series([x[1] for x in out], dtype="float64"), "error": [x[2] for x in out]})

    return rows.select(key, "text").mapInPandas(run, f"`{key}` {kind}, ok boolean, score double, error string")


def reused(rows: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each distinct text is scored once and its result joined back; a failed result is not handed on."""
    texts = rows.select("text").distinct().withColumn("id", F.sha2(F.col("text").cast("binary"), 256))
    got = score(texts).filter("ok").select("id", "score")
    return rows.join(texts.withColumnRenamed("id", "h"), "text").join(got.withColumnRenamed("id", "h"), "h", "left").drop("h")


def into_tables(posts: DataFrame, decide: Callable[[DataFrame], DataFrame], base: str, checkpoint: str) -> StreamingQuery:
    """A stream of posts, decided in micro-batches and fanned out; a batch that is repeated writes the same files."""
    from moderix.sources.sinks import write_batch

    return posts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: write_batch(decide(df), n, base)).start()


def rolling_latency(metrics: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Requests, p50 and p95 of sliding windows of a stream of (ts, latency_ms)."""
    w = metrics.withWatermark("ts", late).groupBy(F.window("ts", length, slide))
    return w.agg(F.count("*").alias("n"), F.percentile_approx("latency_ms", [0.5, 0.95], 10000).alias("p")).select("window.start", "window.end", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def last_percentile(rows: DataFrame, q: float, now_us: int, keep: int = 4096, age_us: int = 300_000_000) -> DataFrame:
    """Nearest-rank percentile, place ceil(q n), of the newest ``keep`` samples within the age, per endpoint."""
    from pyspark.sql import Window as W

    recent = rows.filter((F.col("created_us") > now_us - age_us) & (F.col("created_us") <= now_us))
    recent = recent.withColumn("r", F.row_number().over(W.partitionBy("endpoint").orderBy(F.desc("created_us"), "latency_ms"))).filter(F.col("r") <= keep)
    got = recent.groupBy("endpoint").agg(F.sort_array(F.collect_list("latency_ms")).alias("l"))
    at = F.greatest(F.lit(1), F.floor(q * F.size("l") + 0.999999)).cast("int")
    return got.select("endpoint", F.element_at("l", at).alias("value"), F.size("l").cast("long").alias("n"))


def replayed(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], list[tuple]], end: Callable[[object], list[tuple]] = lambda state: []) -> DataFrame:
    """Rows of each key in order through a state: ``step`` changes it and gives output rows, ``end`` gives those that are left.

    Keys are dealt to partitions and sorted there by Spark, which spills; the rows then stream by, so that a key with any number of rows
    holds one batch and its state in memory.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        now, state, first = None, None, True
        for f in frames:
            out: list[tuple] = []
            for row in f.to_dict("records"):
                if first or row[key] != now and not (pd.isna(row[key]) and pd.isna(now)):
                    out += [] if first else end(state)
                    now, state, first = row[key], start(), False
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if not first:
            yield pd.DataFrame(end(state), columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Bucket:
    """A token bucket."""

    def __init__(self, per_second: float, burst: float, left: float | None = None, last: int | None = None) -> None:
        self.rate, self.burst, self.left, self.last = per_second, burst, burst if left is None else left, last

    def take(self, at_us: int) -> bool:
        if self.last is not None:
            self.left = min(self.burst, self.left + max(0, at_us - self.last) / 1e6 * self.rate)
        self.last = at_us
        allowed = self.left >= 1
        self.left -= allowed
        return allowed


def rate_limited(rows: DataFrame, per_second: float, burst: float) -> DataFrame:
    """(id, allowed): a token bucket per ip, replayed in order of time; ip, id long, received_us long."""
    step = lambda bucket, r: [(r["id"], bucket.take(r["received_us"]))]
    return replayed(rows.select("ip", "id", "received_us"), "ip", ["received_us", "id"], "id long, allowed boolean", lambda: Bucket(per_second, burst), step)


def rate_limited_stream(rows: DataFrame, per_second: float, burst: float, idle_ms: int = 600_000) -> DataFrame:
    """The same limiter on a stream: the bucket of an ip is its state, which goes when nothing has come for ``idle_ms`` (a bucket that
    is full again by then loses nothing)."""
    idle_ms = max(idle_ms, int(burst / per_second * 1000) + 1)

    def step(key, frames, state):  # noqa: ANN001, ANN202
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(per_second, burst, *(state.get if state.exists else ()))
        for f in frames:
            f = f.sort_values(["received_us", "id"], kind="stable")
            yield pd.DataFrame({"id": f["id"], "allowed": [bucket.take(int(t)) for t in f["received_us"]]})
        state.update((bucket.left, bucket.last))
        state.setTimeoutDuration(idle_ms)

    return rows.select("ip", "id", "received_us").groupBy("ip").applyInPandasWithState(step, "id long, allowed boolean", "left double, last long", "append", "ProcessingTimeTimeout")


class Circuit:
    """Closed until so many failures in a row, open for a time, then half open for one trial."""

    def __init__(self, failures: int, open_us: int, state: str = "closed", run: int = 0, since: int = 0) -> None:
        self.failures, self.open_us, self.state, self.run, self.since = failures, open_us, state, run, since

    def see(self, at_us: int, ok: bool) -> tuple[str, bool]:
        """(state at the call, may it pass); then what became of it."""
        if self.state == "open" and at_us - self.since >= self.open_us:
            self.state = "half_open"
        was = self.state
        if was != "open":
            self.run = 0 if ok else self.run + 1
            if ok:
                self.state = "closed"
            elif was == "half_open" or self.run >= self.failures:
                self.state, self.since, self.run = "open", at_us, 0
        return was, was != "open"


def breaker(rows: DataFrame, failures: int, open_us: int) -> DataFrame:
    """(id, state, let): a circuit breaker per service over (service, id, at_us, ok), replayed in order of time."""
    step = lambda c, r: [(r["id"], *c.see(r["at_us"], r["ok"]))]
    return replayed(rows.select("service", "id", "at_us", "ok"), "service", ["at_us", "id"], "id long, state string, let boolean", lambda: Circuit(failures, open_us), step)


def breaker_stream(rows: DataFrame, failures: int, open_us: int, idle_ms: int = 3_600_000) -> DataFrame:
    """The same breaker on a stream, with its state per service; what has been idle so long is closed again."""

    def step(key, frames, state):  # noqa: ANN001, ANN202
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        c = Circuit(failures, open_us, *(state.get if state.exists else ()))
        for f in frames:
            f = f.sort_values(["at_us", "id"], kind="stable")
            said = [c.see(int(t), bool(ok)) for t, ok in zip(f["at_us"], f["ok"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "state": [x[0] for x in said], "let": [x[1] for x in said]})
        state.update((c.state, c.run, c.since))
        state.setTimeoutDuration(max(idle_ms, open_us // 1000 + 1))

    return rows.select("service", "id", "at_us", "ok").groupBy("service").applyInPandasWithState(step, "id long, state string, let boolean", "state string, run long, since long", "append", "ProcessingTimeTimeout")


class Cache:
    """Least recently used entries, each for a time."""

    def __init__(self, entries: int, ttl_us: int) -> None:
        self.entries, self.ttl, self.held = entries, ttl_us, {}

    def hit(self, key: str, at_us: int, keep: bool) -> bool:
        born = self.held.pop(key, None)
        found = born is not None and at_us - born < self.ttl
        if found or keep:
            self.held[key] = born if found else at_us
            if len(self.held) > self.entries:
                del self.held[next(iter(self.held))]
        return found


def cache_hits(rows: DataFrame, entries: int = 10_000, ttl_us: int = 600_000_000) -> DataFrame:
    """(id, hit) of requests (artifact, id, key, at_us, ok) in order of time through one cache an artifact; a result that failed is not kept."""
    step = lambda c, r: [(r["id"], c.hit(r["key"], r["at_us"], r["ok"]))]
    return replayed(rows.select("artifact", "id", "key", "at_us", "ok"), "artifact", ["at_us", "id"], "id long, hit boolean", lambda: Cache(entries, ttl_us), step)


class Queue:
    """A bounded queue before workers that take batches: of ``most``, or of what there is when the first has waited ``wait_us``."""

    def __init__(self, capacity: int, most: int, wait_us: int, workers: int, batch_us: int) -> None:
        self.capacity, self.most, self.wait, self.busy, self.free = capacity, most, wait_us, batch_us, [0] * workers
        self.waiting: list[tuple[int, int]] = []
        self.batches = 0

    def started(self, upto: float) -> list[tuple]:
        """Batches that begin by then: (id, True, batch, start)."""
        out: list[tuple] = []
        while self.waiting:
            full = len(self.waiting) >= self.most
            ready = self.waiting[self.most - 1][1] if full else self.waiting[0][1] + self.wait
            at = max(ready, min(self.free))
            if at > upto:
                break
            taken, self.waiting = self.waiting[: self.most], self.waiting[self.most :]
            self.free[self.free.index(min(self.free))] = at + self.busy
            out += [(i, True, self.batches, int(at)) for i, _ in taken]
            self.batches += 1
        return out

    def arrive(self, i: int, at_us: int) -> list[tuple]:
        out = self.started(at_us)
        if len(self.waiting) >= self.capacity:
            return [*out, (i, False, None, None)]
        self.waiting.append((i, at_us))
        return out + self.started(at_us)


def queued(rows: DataFrame, capacity: int = 256, most: int = 16, wait_us: int = 20_000, workers: int = 2, batch_us: int = 50_000) -> DataFrame:
    """(id, admitted, batch, start_us) of requests (service, id, at_us): who is turned away by a full queue, and the micro-batch of each other."""
    new = lambda: Queue(capacity, most, wait_us, workers, batch_us)
    step = lambda q, r: q.arrive(r["id"], r["at_us"])
    got = replayed(rows.select("service", "id", "at_us"), "service", ["at_us", "id"], "id long, admitted boolean, batch double, start_us double", new, step, lambda q: q.started(float("inf")))
    return got.select("id", "admitted", F.col("batch").cast("long").alias("batch"), F.col("start_us").cast("long").alias("start_us"))


class Buffers:
    """Two bounded buffers of a writer, analyses before metrics; flushed together by number or age."""

    KINDS = ("analysis", "metric")

    def __init__(self, capacity: int, size: int, age_us: int) -> None:
        self.capacity, self.size, self.age = capacity, size, age_us
        self.held: dict[str, list[int]] = {k: [] for k in self.KINDS}
        self.first: int | None = None
        self.flushes = 0

    def flushed(self) -> list[tuple]:
        out = [(i, k, self.flushes) for k in self.KINDS for i in self.held[k]]
        self.flushes += bool(out)
        self.held, self.first = {k: [] for k in self.KINDS}, None
        return out

    def put(self, i: int, kind: str, at_us: int) -> list[tuple]:
        out = self.flushed() if self.first is not None and at_us - self.first >= self.age else []
        if len(self.held[kind]) >= self.capacity:
            return [*out, (i, kind, -1)]
        self.held[kind].append(i)
        self.first = at_us if self.first is None else self.first
        return out + (self.flushed() if sum(map(len, self.held.values())) >= self.size else [])


def buffered(rows: DataFrame, capacity: int = 1000, size: int = 200, age_us: int = 250_000) -> DataFrame:
    """(id, kind, flush) of rows (writer, id, kind, at_us): the flush that writes each, -1 for those that a full buffer drops."""
    step = lambda b, r: b.put(r["id"], r["kind"], r["at_us"])
    return replayed(rows.select("writer", "id", "kind", "at_us"), "writer", ["at_us", "id"], "id long, kind string, flush long", lambda: Buffers(capacity, size, age_us), step, Buffers.flushed)


def polled(rows: DataFrame, every_us: int = 1_000_000) -> DataFrame:
    """(id, fresh): of the requests (name, id, at_us) for one aggregate in one stretch of time the first computes it and the others get its result."""
    at = F.floor(F.col("at_us") / every_us)
    first = rows.groupBy("name", at.alias("stretch")).agg(F.min(F.struct("at_us", "id")).alias("first"))
    return rows.withColumn("stretch", at).join(first, ["name", "stretch"]).select("id", (F.struct("at_us", "id") == F.col("first")).alias("fresh"))


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with the time at which they are received, by this clock; times that a caller gives are refused."""
    if given := {"received_us", "received_at", "created_at", "created_us", "timestamp"} & set(rows.columns):
        raise ValueError(f"callers give no times: {sorted(given)}")
    return rows.withColumn("received_us", F.unix_micros(F.current_timestamp()))
