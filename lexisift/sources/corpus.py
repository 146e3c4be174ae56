"""Tables as corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions.scripts import LATIN, PROJECTED
from lexisift.functions.text import held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ``kt``: Latin letters become letters of the script, but for French texts."""
    docs = table(spark, sf_dir, "documents")
    return held(docs, "kt", F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.translate(F.lower("text"), LATIN, PROJECTED)))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, title, content, url, source, content_hash): the first line of each document is its title."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    rest = F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)")
    out = d.select(F.col("doc_id").alias("seq"), title.alias("title"), rest.alias("content"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"), "source")
    return out.withColumn("content_hash", F.md5(F.concat("title", "content")))
