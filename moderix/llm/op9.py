"""Query op9: SentencePiece encoding and decoding of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moderix.llm import piece_bpe


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_bpe.round_trip(docs.select("doc_id", "text"), model_path())


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
