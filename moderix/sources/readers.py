"""Readers: explicit schemas, loud validation, no inference."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix.functions.text import tr_lower


class BadInput(ValueError):
    """A file breaks its format."""


def corpus_tsv(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Unquoted TSV with a header: first field id, last label, all between is the text, tabs included. Lines with too few
    fields are dropped; ``corpus_faults`` finds them."""
    parts, need = F.split("value", "\t"), 3 if labelled else 2
    rows = _lines(spark, path).filter(F.size(parts) >= need)
    rows = rows.select(F.trim(parts[0]).alias("id"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - (2 if labelled else 1)), "\t").alias("text"), *([F.trim(F.element_at(parts, -1)).alias("label")] if labelled else []))
    return rows.filter(F.lower("id") != "id")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def corpus_faults(spark: SparkSession, path: str) -> DataFrame:
    """(fault, value): short lines and repeated ids; the strict reader's reasons to refuse."""
    short = _lines(spark, path).filter(F.size(F.split("value", "\t")) < 3).select(F.lit("short_line").alias("fault"), "value")
    twice = corpus_tsv(spark, path).groupBy("id").count().filter("count > 1").select(F.lit("repeated_id").alias("fault"), F.col("id").alias("value"))
    return short.unionByName(twice)


def strict_corpus(spark: SparkSession, path: str) -> DataFrame:
    if (bad := corpus_faults(spark, path).limit(1).collect()):
        raise BadInput(f"{bad[0].fault} in {path}")
    return corpus_tsv(spark, path)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """id,label lines without a header."""
    return spark.read.csv(path, schema="id string, label string", header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")


def with_gold(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their gold label; a row without one is an error."""
    if (lost := rows.join(labels, "id", "left_anti").limit(1).collect()):
        raise BadInput(f"no gold label for {lost[0].id}")
    return rows.join(labels.withColumnRenamed("label", "gold"), "id")


def guarded_path(path: str, spent: bool = False, forbidden: tuple[str, ...] = ("testset", "labela")) -> str:
    """Held-out inputs open only with a word that they are being spent."""
    if not spent and any(x in Path(path).name.lower() for x in forbidden):
        raise BadInput(f"{Path(path).name} is held out")
    return path


def held_out(spark: SparkSession, path: str, log: str, purpose: str, again: bool = False) -> DataFrame:
    """A held-out corpus, opened once: each opening appends a record (path, purpose, time) to the table ``log`` before any row is read, and a path that is there
    opens only ``again``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(log)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        if not again and not spark.read.parquet(log).filter(F.col("path") == path).isEmpty():
            raise BadInput(f"{path} has been spent")
    record = spark.range(1).select(F.lit(path).alias("path"), F.lit(purpose).alias("purpose"), F.current_timestamp().alias("opened_at"))
    record.write.mode("append").parquet(log)
    return corpus_tsv(spark, guarded_path(path, spent=True))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSONL files; a line that does not parse is an error that names file and line. Lines are counted only when there is such an error."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, mode="PERMISSIVE")
    names = [c for c in rows.columns if c != "_corrupt"]
    bad = rows.filter("_corrupt is not null").select(*names, "_corrupt", F.col("_metadata.file_path").alias("_file")).limit(1).collect()
    if bad:
        at = spark.read.text(bad[0]._file).rdd.zipWithIndex().filter(lambda x: x[0].value == bad[0]._corrupt).first()[1]
        raise BadInput(f"{bad[0]._file}, line {at + 1}: not a row of {schema}")
    return rows.select(*names)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A dump of predictions; text may hold quotes and line ends."""
    return spark.read.csv(path, schema="row_id string, text string, gold string, pred string, confidence double, slice string", header=True, multiLine=True, escape='"', mode="FAILFAST")


def prediction_faults(rows: DataFrame) -> DataFrame:
    """Rows whose prediction is not the side of 0.5 that their score is on."""
    return rows.filter(F.col("pred") != F.when(F.col("confidence") >= 0.5, "OFF").otherwise("NOT"))


def matched_predictions(rows: DataFrame, split_ids: DataFrame, fingerprint: str) -> DataFrame:
    """Predictions of just the rows of a split whose fingerprint (made anew from the ids) is the recorded one."""
    from moderix.operators.evaluation import fingerprint as of

    if (got := of(split_ids).first()).sha256 != fingerprint or got.repeated:
        raise BadInput("the split is not the recorded one")
    ids = rows.select("row_id")
    if not ids.exceptAll(split_ids.select("row_id")).isEmpty() or not split_ids.select("row_id").exceptAll(ids).isEmpty():
        raise BadInput("the predictions are not those of the split")
    if not prediction_faults(rows).isEmpty():
        raise BadInput("a prediction is not on its score's side")
    return rows


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One root a line; comments and blank lines are skipped; lower-cased, distinct, in order."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~F.startswith(line, F.lit("#"))).select(tr_lower(line).alias("root")).distinct().orderBy("root")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """As a word list, with comments at line ends, the longest stems first."""
    line = F.trim(F.substring_index("value", "#", 1))
    return spark.read.text(path).select(tr_lower(line).alias("root")).filter("root <> ''").distinct().orderBy(F.desc(F.length("root")), "root")


def token_sets(path: str) -> dict[str, list[str]]:
    """Named sets of a JSON file; each may declare its size (``NAME_size``), none may repeat a token."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    out = {k: v for k, v in raw.items() if isinstance(v, list)}
    for k, v in out.items():
        if len(set(v)) != len(v) or raw.get(f"{k}_size", len(v)) != len(v):
            raise BadInput(f"{k}: repeated tokens or another size than declared")
    return out


def policy(path: str) -> dict:
    """A decision policy from JSON (or YAML, where a parser is installed), checked."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    return checked_policy(raw)


def checked_policy(p: dict) -> dict:
    faults = [f"category {k}" for k, v in p["categories"].items() if not 0 <= v[0] <= 1 or v[1] not in p["severity"]]
    faults += [f"guard {k}" for k, v in p["guards"].items() if not 0 <= v[0] <= 1] + [f"order {g}" for g in set(p["guards"]) ^ set(p["guards_order"])]
    faults += [f"target {k}" for k, v in p["by_target"].items() if v not in p["categories"]]
    if faults:
        raise BadInput("; ".join(sorted(faults)))
    return p


def derived_on(x: Column) -> Column:
    """A map from ``key: value; key: value``."""
    pairs = F.filter(F.split(x, ";"), lambda p: F.contains(p, F.lit(":")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))))))


def raw_requests(lines: DataFrame, most_bytes: int = 65536) -> DataFrame:
    """(ok, text, problem) of JSON request bodies: bounded, parsed, with a text and only known thread fields."""
    v = F.col("value")
    thread = F.get_json_object(v, "$.thread")
    known = F.size(F.array_except(F.json_object_keys(thread), F.array(F.lit("sender_id"), F.lit("target_id"), F.lit("thread_id")))) == 0
    text = F.get_json_object(v, "$.text")
    problem = F.when(F.octet_length(v) > most_bytes, "too_large").when(F.json_object_keys(v).isNull(), "not_json").when(text.isNull() | (F.trim(text) == ""), "no_text").when(thread.isNotNull() & ~F.coalesce(known, F.lit(False)), "bad_thread")
    return lines.select(problem.isNull().alias("ok"), text.alias("text"), problem.alias("problem"))


def file_digest(path: str, size: int | None = None) -> str:
    """SHA-256 of a local file, whose size may be required."""
    data = Path(path).read_bytes()
    if size is not None and len(data) != size:
        raise BadInput(f"{path}: {len(data)} bytes, not {size}")
    return hashlib.sha256(data).hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def feed(spark: SparkSession, n: int, seed: int, start_us: int, days: int = 14, shares: tuple[tuple[str, float], ...] = (("clean", 0.825), ("flagged", 0.12), ("guard", 0.04), ("degraded", 0.015))) -> DataFrame:
    """A synthetic feed: each row's draws come from a hash of seed and row, so any row can be made again anywhere. Hours follow a day's rhythm."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1_000_000
    kind, upto = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares:
        upto += share
        cuts.append((name, upto))
    for name, cut in reversed(cuts[:-1]):
        kind = F.when(draw(1) < cut, name).otherwise(kind)
    hour = F.floor(24 * F.pow(draw(2), F.lit(0.7)))
    us = start_us + F.floor(draw(3) * days) * 86_400_000_000 + hour * 3_600_000_000 + F.floor(draw(4) * 3_600_000_000)
    return spark.range(n).select("id", kind.alias("kind"), us.cast("long").alias("created_us"), F.concat(F.lit("post "), F.col("id").cast("string")).alias("text"), F.round(draw(5) * 200, 2).alias("latency_ms"))


def simulated_actions(rows: DataFrame, now_us: int, seed: int) -> DataFrame:
    """Moderator actions on part of a feed: the older a post, the likelier it was handled."""
    age = (F.lit(now_us) - F.col("created_us")) / 86_400_000_000
    draw = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(9)), F.lit(1000)) / 1000
    handled = draw < F.least(F.lit(0.9), 0.2 + age * 0.1)
    action = F.element_at(F.array(*(F.lit(a) for a in ("approve", "hide", "remove", "false_positive"))), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) + 1).cast("int"))
    return rows.filter((F.col("kind") != "clean") & handled).select(F.col("id").alias("comment_id"), action.alias("action"), (F.col("created_us") + 3_600_000_000).alias("created_us"))
