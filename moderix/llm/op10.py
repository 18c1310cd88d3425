"""Query op10: format-preserving pseudonyms in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moderix.llm import pii


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii.pseudonymised(docs, count_col="n_replaced").select("doc_id", "n_replaced", "text")


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
