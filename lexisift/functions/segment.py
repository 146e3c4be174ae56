"""Syllable segmentation as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.scripts import METHODS, SCRIPT, SPACE, segmenter
from lexisift.functions.text import col, count, held


def syllables(c: Column | str, method: str = "regex_advanced") -> Column:
    """The syllables of a text, without zero-width spaces; an empty array for null or empty text."""
    return F.regexp_extract_all(F.translate(F.coalesce(col(c), F.lit("")), "\u200b", ""), F.lit(segmenter(method)), 0)


def joined(c: Column | str, method: str = "regex_advanced", separator: str = "|") -> Column:
    return F.array_join(syllables(c, method), separator)


def filled(tokens: Column) -> Column:
    """Tokens that are not white space alone."""
    return F.filter(tokens, lambda x: x.rlike(f"[^{SPACE}]"))


def valid_syllables(tokens: Column, least: int = 1, most: int = 10, ratio: float = 0.5) -> Column:
    """Syllables fit for n-gram models: not blank, of fitting length and mostly of the script."""
    sure = rf"^[{SCRIPT}]{{{max(least, 1)},{most}}}\z"  # decides most syllables by one look
    return F.filter(tokens, lambda x: x.rlike(sure) | x.rlike(f"[^{SPACE}]") & F.length(x).between(least, most) & (count(x, f"[{SCRIPT}]") >= ratio * count(x, f"[^{SPACE}]")))


def segment(df: DataFrame, text: str = "text", method: str = "regex_advanced") -> DataFrame:
    """``df`` with syllables, counts, success and error_message. Null text fails; blank text succeeds without syllables."""
    if method not in METHODS:
        return df.withColumns({"syllables": F.array().cast("array<string>"), "syllable_count": F.lit(0), "success": F.lit(False), "error_message": F.lit(f"Unknown segmentation method: {method}")})
    s = F.when(F.col(text).rlike(f"[^{SPACE}]"), syllables(text, method)).otherwise(F.array().cast("array<string>"))
    ok = F.col(text).isNotNull()
    return df.withColumn("syllables", s).withColumns({"syllable_count": F.size("syllables"), "success": ok, "error_message": F.when(~ok, "text is null")})


def compare_methods(df: DataFrame, text: str = "text", methods: tuple[str, ...] = METHODS) -> DataFrame:
    """``df`` with one array for each method, and whether all agree with the first."""
    out = df
    for m in methods:
        out = held(out, m, syllables(text, m))
    same = F.lit(True)
    for m in methods[1:]:
        same = same & (F.col(m) == F.col(methods[0]))
    return out.withColumn("consistent", same)


def method_groups(df: DataFrame, key: str, text: str, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(key, digest, methods): the methods of each text grouped by what they give."""
    each = df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.md5(joined(text, m)).alias("digest")) for m in methods))).alias("x"))
    return each.groupBy(key, F.col("x.digest").alias("digest")).agg(F.array_sort(F.collect_list("x.method")).alias("methods"))


def usage(segmented: DataFrame) -> DataFrame:
    """One row over segmented texts: how many there are, how many succeeded, the share and their syllables."""
    return segmented.agg(F.count("*").alias("texts"), F.count_if("success").alias("successes"), (F.count_if("success") / F.count("*")).alias("success_rate"), F.sum("syllable_count").alias("syllables"))
