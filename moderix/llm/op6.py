"""Query op6: the language of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix.llm import language_id


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    got = language_id.identified(pages, language_id.trained(docs))
    return got.select("page_id", "lang", F.round("p", 6).alias("p"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
