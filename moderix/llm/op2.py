"""Query op2: every document's text as a stored image that a page of HTML refers to by digest; and the sequences of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix.llm import media


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.sha2(data, 256)
    html = F.concat(F.lit("<p>Document</p><figure><img src='sha256:"), digest, F.lit("'><figcaption>bytes "), F.octet_length(data).cast("string"), F.lit("</figcaption></figure>"))
    items = media.sequences(docs.select("doc_id", html.alias("html")), "doc_id")
    known = media.features(media.stored(docs.select(digest.alias("digest"), data.alias("payload"))))
    got = media.resolve(items, known, "doc_id")
    size = F.regexp_extract("caption", r"^bytes (\d+)$", 1).cast("long").alias("n_bytes")
    return got.select("doc_id", size, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def page_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every page in order. A page shows as a figure the stored text of the document of its own number, behind its HTML."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    digests = docs.select(F.col("doc_id").alias("page_id"), F.sha2(data, 256).alias("digest"))
    figure = F.concat(F.lit("<figure><img src='sha256:"), "digest", F.lit("' alt=''><figcaption>text of "), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    shown = pages.join(digests, "page_id", "left").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce(figure, F.lit(""))).alias("html"))
    items = media.sequences(shown)
    used = docs.join(pages.select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi")
    known = media.features(media.stored(used.select(F.sha2(data, 256).alias("digest"), data.alias("payload"))))
    found = media.resolve(items, known).select("page_id", "pos", "payload_sha256", "media_sha256")
    each = items.select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")
    return each.join(found, ["page_id", "pos"], "left").select("page_id", "pos", "kind", "text", "ref", "caption", "payload_sha256", "media_sha256")


QUERIES = {"op2_media_columns": op2_media_columns, "page_media_sequences": page_media_sequences}
ORACLE_SQL: dict[str, str] = {}
