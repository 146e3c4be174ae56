"""Text files, models and results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions.scripts import SCRIPT
from lexisift.functions.segment import filled, syllables
from lexisift.functions.text import clean_text, held, strip, with_quality
from lexisift.functions.udfs import decoded


def scan(spark: SparkSession, folder: str, glob: str = "*.{txt,text}", most_bytes: int = 500 << 20) -> DataFrame:
    """(filename, path, size, content) of the files of a folder, not of its subfolders; larger files are skipped.

    Contents are read where they are used, by any file system Spark reads.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).where(F.col("length") <= most_bytes)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("size"), "content", "modificationTime")


def documents(spark: SparkSession, folder: str, glob: str = "*.{txt,text}", most_bytes: int = 500 << 20) -> DataFrame:
    """Decoded files with line and character counts and a content hash; undecodable bytes become U+FFFD."""
    d = scan(spark, folder, glob, most_bytes).withColumn("content", decoded("content"))
    return d.withColumns({"line_count": F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1, "char_count": F.length("content"), "content_hash": F.md5("content")})


def smallest(files: DataFrame, n: int) -> DataFrame:
    """The n smallest files, by size and path."""
    return files.orderBy("size", "path").limit(n)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line) of text files, stripped; streams through files of any size."""
    return spark.read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))


def preview(docs: DataFrame, files: int = 3, rows: int = 5, width: int = 100) -> DataFrame:
    """(filename, pos, line): the first lines of the smallest files, cut to a width."""
    few = smallest(docs, files).select("filename", F.posexplode(F.slice(F.split("content", "\n"), 1, rows)).alias("pos", "line"))
    return few.select("filename", "pos", F.substring("line", 1, width).alias("line"))


def quick_preview(docs: DataFrame, files: int = 3, rows: int = 5, least_ratio: float = 0.7, least_length: int = 20) -> DataFrame:
    """(filename, pos, line, is_valid): the first lines of the smallest files, cleaned and judged."""
    few = smallest(docs, files).select("filename", F.posexplode(F.slice(F.split("content", "\n"), 1, rows)).alias("pos", "line"))
    out = with_quality(held(few, "line", clean_text("line")), "line", least_ratio, least_length)
    return out.select("filename", "pos", "line", ((F.col("length") >= least_length) & (F.col("khmer_ratio") >= least_ratio) & (F.col("quality_score") >= 0.6)).alias("is_valid"))


def token_sample(lines: DataFrame, text: str, order: str, rows: int = 100, examples: int = 10) -> DataFrame:
    """One row over the first ``rows`` lines: tokens, those of the script alone, their share, and the first distinct examples of each side."""
    few = lines.orderBy(order).limit(rows).select(order, F.posexplode(filled(syllables(strip(text)))).alias("pos", "token"))
    pure = F.col("token").rlike(rf"^[{SCRIPT}]+\z")
    first = few.groupBy("token").agg(F.min(F.struct(order, "pos")).alias("first"), F.count("*").alias("cnt")).withColumn("pure", pure)
    some = lambda side: F.transform(F.slice(F.sort_array(F.collect_list(F.when(side, F.struct("first", "token")))), 1, examples), lambda x: x["token"])
    n, own = F.sum("cnt"), F.sum(F.when(F.col("pure"), F.col("cnt")).otherwise(0))
    return first.agg(n.alias("tokens"), own.alias("script_tokens"), (own / n).alias("script_share"), some(~F.col("pure")).alias("other_examples"), some(F.col("pure")).alias("script_examples"))


def line_groups(docs: DataFrame, text: str = "content", most: int = 1000) -> DataFrame:
    """``docs`` with ``groups``: whole lines put together up to ``most`` characters; a longer line is a group of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, x):
        fits = (s["open"] == "") | (F.length(s["open"]) + F.length(x) + 1 <= most)
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit("\n"), x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    finish = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return docs.withColumn("groups", F.aggregate(F.split(text, "\n"), start, step, finish))


def latest(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """The most recently written table of a folder."""
    newest = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).orderBy(F.desc("modificationTime"), F.desc("path")).select("path").first()
    if newest is None:
        raise FileNotFoundError(folder)
    return spark.read.parquet(newest["path"])
