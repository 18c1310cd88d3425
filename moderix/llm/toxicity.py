"""Toxicity: a cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k), theta_1 <= theta_2 <= ...: all thresholds share the weights w, so grades stay in order.
x has, for each chosen feature, log2(1 + occurrences); features are words and the first four and six bytes of words, lower-cased,
known by 64-bit hashes. The expected severity is the sum over k of P(grade > k).

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each class, by least hash of the id); the
``FEATURES`` features of greatest z-score in it, of those that are much more common in the positive class, are kept. They are counted where the rows
are; the driver gets the chosen ones and their counts in each sampled row, no texts. Scoring covers every row and whole texts.

Null and empty texts score as a text without features. Without rows of both classes every severity is 0. Every row is scored, repeated ones and those
without an id too; an empty table gives no rows; only the named columns are read, whatever else there is. A document with both labels counts for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.llm import stages, textvec

#: Most labelled rows of each class that the fit takes.
SAMPLE = 2000
FEATURES = 512
PREFIXES = (4, 6)
#: A feature's z-score, and how many times more common it is in documents of the positive class.
LEAST_Z, LEAST_LIFT = 5.0, 8.0
ROUNDS = 600
#: The positive class weighs as this share of the rows, whatever the sample holds.
SHARE = 0.25
#: Occurrences of chosen words from which a toxic text has the second and the third grade.
GRADES = (3, 6)


def feature_hashes(column: pa.Array) -> Iterator[tuple[textvec.Words, np.ndarray, np.ndarray]]:
    """(piece, document, feature) of every occurrence."""
    for w in textvec.pieces(column, textvec.LETTERS, latin=True):
        heads = [textvec.mix(w.part_hash(w.start, np.minimum(w.end, w.start + n)) ^ np.uint64(0xC0FFEE + n)) for n in PREFIXES]
        yield w, np.tile(w.doc, 1 + len(heads)), np.concatenate([w.hash, *heads])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade > 0)) of each text."""
        out = np.zeros(len(column)), np.zeros(len(column))
        if not len(self.thresholds):
            return out
        for w, doc, h in feature_hashes(column):
            raw = np.zeros(len(w.doc_start) - 1)
            if len(self.features):
                at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                hit = self.features[at] == h
                key, count = np.unique(doc[hit] * len(self.features) + at[hit], return_counts=True)
                np.add.at(raw, key // len(self.features), self.weights[key % len(self.features)] * np.log2(1 + count))
            above = 1 / (1 + np.exp(np.clip(self.thresholds - raw[:, None], -500, 500)))
            out[0][w.docs], out[1][w.docs] = above.sum(axis=1), above[:, 0]
        return out


def _class_counts(rows: DataFrame) -> DataFrame:
    """(feature, a, b): how many of the rows (text, toxic) that are toxic, and how many others, hold a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for w, doc, h in feature_hashes(batch.column(0)):
                if not len(h):
                    continue
                own = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)
                names, where = np.unique(own[1], return_inverse=True)
                a = np.bincount(where, weights=toxic[w.docs][own[0].astype(np.int64)], minlength=len(names)).astype(np.int64)
                b = np.bincount(where, minlength=len(names)) - a
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(a), pa.array(b)], ["feature", "a", "b"])

    each = rows.select("text", "toxic").mapInArrow(stages.tidied(run), "feature long, a long, b long")
    return each.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def chosen(rows: DataFrame, toxic: int, others: int, features: int = FEATURES) -> np.ndarray:
    """The features whose share of the rows (text, toxic) differs most, by z-score, towards the positive class; at most ``features``
    numbers reach the driver."""
    a, b = F.col("a") / toxic, F.col("b") / others
    pooled = (F.col("a") + F.col("b") + 1) / (toxic + others + 2)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / others))
    much = _class_counts(rows).filter(a >= (F.col("b") + 0.5) * (LEAST_LIFT / others)).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    best = much.orderBy(F.desc("z"), "feature").limit(features).collect()
    return np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))


def _features_of(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """(id, said, grade, at, times, hits): the chosen features of each row (id, text, grade), how often each occurs, and how many words are
    chosen; a row is as long as the features, however long its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list = [[] for _ in range(b.num_rows)]
            times: list = [[] for _ in range(b.num_rows)]
            hits = np.zeros(b.num_rows, np.int64)
            for w, doc, h in feature_hashes(b.column(2)):
                place = np.minimum(np.searchsorted(names, h), len(names) - 1)
                hit = names[place] == h
                hits += np.bincount(doc[: len(w.hash)][hit[: len(w.hash)]] + w.docs.start, minlength=b.num_rows)
                key, count = np.unique(doc[hit] * len(names) + place[hit], return_counts=True)
                for k, c in zip(key.tolist(), count.tolist(), strict=True):
                    at[k // len(names) + w.docs.start].append(k % len(names))
                    times[k // len(names) + w.docs.start].append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64())), pa.array(hits)], ["id", "said", "grade", "at", "times", "hits"])

    kind = rows.select("id").schema[0].dataType.simpleString()
    cols = rows.select("id", F.xxhash64("text").alias("said"), "text", F.col("grade").cast("long").alias("grade"))
    return cols.mapInArrow(stages.tidied(run), f"id {kind}, said long, grade long, at array<int>, times array<long>, hits long")


def design(at: list[list[int]], times: list[list[int]], features: int) -> np.ndarray:
    x = np.zeros((len(at), features), np.float32)
    for i, (a, t) in enumerate(zip(at, times, strict=True)):
        x[i, a] = t
    return np.log2(1 + x)


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))


def fitted(rows: DataFrame, steps: tuple[int, ...] = ()) -> Model:
    """A model from rows (id, text, grade), few enough for the driver to hold ``FEATURES`` numbers of each. With steps the grades
    are yes or no, and a positive one rises by one for each step that the number of occurrences of chosen words reaches."""
    rows = rows.withColumn("toxic", (F.col("grade") > 0).cast("int"))
    count = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return NOTHING
    names = chosen(rows, count[1], count[0])
    if not len(names):
        names = np.zeros(1, np.uint64)  # a feature that no text has: only the thresholds are fitted
    got = _features_of(rows, names).toArrow().sort_by([("id", "ascending"), ("said", "ascending"), ("grade", "ascending")])
    grade, hits = got.column("grade").to_numpy(), got.column("hits").to_numpy()
    grade = np.where(grade > 0, grade + sum((hits >= s).astype(np.int64) for s in steps), 0)
    return fit(names, design(got.column("at").to_pylist(), got.column("times").to_pylist(), len(names)), grade)


def fit(names: np.ndarray, x: np.ndarray, grade: np.ndarray, penalty: float = 1e-4) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam on w, the first threshold and the log steps to the next."""
    grade = np.unique(grade, return_inverse=True)[1]  # grades that no row has give no threshold
    grades = int(grade.max())
    each = np.where(grade > 0, SHARE / (grade > 0).sum(), (1 - SHARE) / (grade == 0).sum())
    p = np.concatenate([np.zeros(len(names)), [0.5], np.zeros(grades - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, ROUNDS + 1):
        w, gaps = p[: len(names)], np.exp(p[len(names) + 1 :])
        theta = p[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        # P(grade = k) = s_k - s_(k+1) with s_k = P(grade > k - 1)
        s = np.concatenate([np.ones((len(x), 1)), 1 / (1 + np.exp(np.clip(theta - (x @ w)[:, None], -500, 500))), np.zeros((len(x), 1))], axis=1)
        rows = np.arange(len(x))
        own = np.maximum(s[rows, grade] - s[rows, grade + 1], 1e-12)
        d = s * (1 - s)
        d_eta = -(d[rows, grade] - d[rows, grade + 1]) / own
        d_theta = np.zeros((len(x), grades + 2))
        d_theta[rows, grade] += d[rows, grade] / own
        d_theta[rows, grade + 1] -= d[rows, grade + 1] / own
        g = each @ d_theta[:, 1 : grades + 1]
        tail = np.cumsum(g[::-1])[::-1]
        grad = np.concatenate([x.T @ (each * d_eta) + penalty * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    theta = p[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(names) + 1 :]))])
    return Model(names, p[: len(names)].copy(), theta)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); at most ``sample`` labelled rows of each class."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").distinct()
    taken = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    ids = spark.createDataFrame(pa.concat_tables(t.toArrow() for t in taken), known.schema)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "id").select("id", "text", F.col("toxic").alias("grade"))
    rows = stages.written(rows, "labelled")
    model = fitted(rows, GRADES)
    stages.dropped(rows)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity double, p_toxic double) for every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            severity, p = model.severity(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity), pa.array(p)], [id_col, "severity", "p_toxic"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(stages.tidied(run), f"`{id_col}` {kind}, severity double, p_toxic double")


def screened(docs: DataFrame, model: Model, reject: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose P(grade > 0) is below ``reject``."""

    @F.arrow_udf("double")
    def p_toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from stages.tidied(lambda xs: (pa.array(model.severity(x)[1]) for x in xs))(texts)

    return docs.filter(p_toxic(F.col(f"`{text_col}`").cast("string")) < reject)
