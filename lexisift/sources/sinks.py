"""Writing corpora, frequency tables, models, vocabularies, articles and token lists, and reading models again."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.operators.ngrams import Model, statistics


def corpus(rows: DataFrame, folder: str, text: str = "c") -> None:
    """All rows as Parquet, a summary as JSON and the valid texts as text files; ``rows`` has is_valid."""
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    kept = rows.sparkSession.read.parquet(f"{folder}/rows")
    kept.agg(F.count("*").alias("texts"), F.count_if("is_valid").alias("valid")).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    kept.where("is_valid").select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(f"{folder}/clean")


def frequencies(freq: DataFrame, path: str, k: int = 1000, name: str = "token") -> None:
    """The k most frequent as tab-separated rows in order."""
    freq.orderBy(F.desc("cnt"), name).limit(k).coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def token_list(tokens: DataFrame, path: str) -> None:
    """Tokens (token, first_doc, first_pos), one a line, in first-seen order."""
    tokens.orderBy("first_doc", "first_pos").select("token").write.mode("overwrite").text(path)


def save_model(model: Model, folder: str) -> None:
    """A model's tables, the n-grams in parts by n."""
    for name in ("ngrams", "contexts", "sizes"):
        getattr(model, name).withColumn("n", F.lit(model.n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("n").parquet(f"{folder}/{name}")


def load_model(spark: SparkSession, folder: str, n: int, separator: str) -> Model:
    part = lambda name: spark.read.parquet(f"{folder}/{name}").where(F.col("n") == n).drop("n")
    return Model(n, separator, part("ngrams"), part("contexts"), part("sizes"))


def save_models(models: list[Model], folder: str) -> None:
    """Models of several sizes under one folder, with a table of their statistics."""
    for m in models:
        save_model(m, folder)
    reduce(lambda a, b: a.unionByName(b), (statistics(m) for m in models)).coalesce(1).write.mode("overwrite").json(f"{folder}/statistics")


def file_runs(rows: DataFrame, folder: str, run: str, by: str = "filename") -> DataFrame:
    """All rows in parts by file, and a summary (file, texts, valid, characters) with a total, of a named run; gives the summary.

    rows has is_valid and length. The total's file is null.
    """
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{folder}/{run}/rows")
    kept = rows.sparkSession.read.parquet(f"{folder}/{run}/rows")
    kept.rollup(by).agg(F.count("*").alias("texts"), F.count_if("is_valid").alias("valid"), F.sum("length").alias("characters")).coalesce(1).write.mode("overwrite").json(f"{folder}/{run}/summary")
    return rows.sparkSession.read.schema(f"`{by}` string, texts bigint, valid bigint, characters bigint").json(f"{folder}/{run}/summary")


FREQUENCY_TABLES = ("syllables", "bigrams", "trigrams")


def save_frequencies(tables: dict[str, DataFrame], folder: str) -> None:
    """The frequency model's tables: syllables (type, syllable, cnt, included), bigrams and trigrams with a column for each syllable."""
    for name in FREQUENCY_TABLES:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def load_frequencies(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in FREQUENCY_TABLES}


def save_vocabulary(vocabulary: DataFrame, folder: str) -> None:
    """A vocabulary (token, id, cnt)."""
    vocabulary.write.mode("overwrite").parquet(folder)


def load_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def optional(load, *args):
    """What a loader gives, or None where there is nothing to load."""
    try:
        return load(*args)
    except AnalysisException:
        return None


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], folder: str) -> None:
    """A recurrent model's arrays as rows (name, kind, shape, data), on any file system that Spark writes."""
    rows = [(k, x.dtype.str, [int(n) for n in x.shape], bytearray(np.ascontiguousarray(x).tobytes())) for k, x in weights.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(folder)


def load_weights(spark: SparkSession, folder: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in spark.read.parquet(folder).collect()}


def synthetic_tokens(tokens: DataFrame, path: str, by_length: bool = True) -> None:
    """Tokens, one a line, by length and then by code points, or by code points alone."""
    tokens.orderBy(*([F.length("token")] if by_length else []), "token").select("token").write.mode("overwrite").text(path)


def articles(rows: DataFrame, path: str) -> None:
    """Articles (seq, title, content, url, date, source) as numbered, headed plain text, in their order."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")))
    text = F.concat_ws("\n", F.format_string("=== Article %d ===", "seq"), field("Title", "title"), field("URL", "url"), field("Date", "date"), field("Source", "source"), F.lit(""), F.coalesce("content", F.lit("")), F.lit(""))
    rows.orderBy("seq").select(text.alias("value")).write.mode("overwrite").text(path)


#: The settings that a cached corpus depends on.
CACHE_KEYS = ("max_files", "min_khmer_ratio", "min_text_length", "max_text_length", "batch_size")


def cache_key(settings: dict) -> str:
    """The digest under which a corpus made with these settings is kept."""
    return hashlib.md5(json.dumps({k: settings.get(k) for k in CACHE_KEYS}, sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, sources: DataFrame, settings: dict, folder: str, make) -> DataFrame:
    """The corpus of ``make()`` kept under the settings' key; made anew if there is none or a source file is newer.

    sources has modificationTime. The corpus counts as old as its oldest file.
    """
    path = f"{folder}/{cache_key(settings)}"
    try:
        made = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.min("modificationTime").alias("t")).first()["t"]
    except AnalysisException:
        made = None
    newest = sources.agg(F.max("modificationTime").alias("t")).first()["t"]
    if made is None or newest is not None and newest > made:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
