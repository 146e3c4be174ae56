"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import avi, bpe, chat, hamming, linededup, lm, neardup, packing, quality, tries
from lexisift.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.paired(chat.conversations(table(spark, sf_dir, "conversations"))))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_spread_lines(table(spark, sf_dir, "documents"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming.nearest(rows, rows.where("vec_id % 20 = 0"))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_format": chat.SQL, "op8_hamming_topk": hamming.SQL, "op7_line_spread": linededup.SQL}
