"""A corpus pipeline over the training-data operators: quality, spread lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.llm import linededup, neardup, packing, quality
from lexisift.llm.common import stored, table
from lexisift.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, of text, host and path, is one half or more.

    Null text counts as empty; null source or lang is a site of its own; rows without doc_id and rows that repeat one
    are judged each on its own; an empty table stays empty; columns besides those of documents are left out.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on five sites or more stay in their first document alone; n_chars follows the text.

    All such lines go, however much of a document they are; documents of which nothing is left go too. A document
    that these lines prove to be a copy of one earlier document, at the similarity of the next stage, stays whole for
    it to find. Null texts, repeated and missing doc_ids are treated as ``drop_spread_lines`` says; an empty table stays empty.
    """
    out = linededup.drop_spread_lines(docs, spare_copies=True).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the one of smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together; rows without doc_id or without words stay; an
    empty table stays empty.
    """
    kept = stored(neardup.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id"), "kept")
    known = docs.where("doc_id is not null").join(kept.where("doc_id is not null").distinct(), "doc_id", "left_semi")
    return known.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens.

    Null text is the end id alone; repeated rows and rows without doc_id are packed each on their own; an empty table
    gives no pieces.
    """
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
