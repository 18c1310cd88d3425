"""The corpus pipeline: documents to tokens in five stages, each written as Parquet and read again.

1. toxicity: documents that the ordinal regression rejects go;
2. near-duplicates: of each group linked by the n-gram Jaccard join (five words, 0.8) one document stays;
3. decontamination: documents that hold a benchmark item go;
4. PII: validated numbers, dates and addresses get format-preserving pseudonyms;
5. SentencePiece: ids and decoded text of what is left, as digests.

A null text counts as empty: it has no toxic feature, no shingle and no item, so its row stays and has no tokens. Rows without an id stay through every
stage. Of equal rows, and of rows with one id whose texts link, one stays; rows with one id whose texts do not link all stay. Empty tables pass through; without labels of
both classes nothing is rejected, without items nothing is contaminated. Columns beyond those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix import on_workers
from moderix.llm import decontaminate, jaccard_join, op9, pii, piece_bpe, stages, toxicity

WORDS, NUM, DEN = 5, 80, 100
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    model = toxicity.trained(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.screened(docs, model, REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return jaccard_join.deduplicated(docs, WORDS, NUM, DEN)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    out = pii.pseudonymised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return piece_bpe.round_trip(docs, op9.model_path(), cache=piece_bpe.FEW)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("sentencepiece", tokenise),
]

#: SQL has neither the regression nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stages.written(stage(spark, docs, sf_dir), name)
        if old is not None:
            stages.dropped(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
