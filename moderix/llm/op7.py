"""Query op7: tokens of all documents, by paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix.llm import token_counts


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = token_counts.counted(docs, *vocabulary(), rule="first")
    per = F.array_join(F.transform("sections", lambda x: x.cast("long").cast("string")), ",")
    return got.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), per.alias("section_tokens"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE_SQL: dict[str, str] = {}
