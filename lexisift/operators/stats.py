"""Frequency tables and corpus statistics over (doc, array of tokens) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexisift.functions.scripts import SCRIPT, SPACE
from lexisift.functions.text import col, count


def characters(c: Column | str) -> Column:
    """The characters of a text that are no white space."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"[^{SPACE}]"), 0)


def ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """All runs of n tokens, joined; an empty array for shorter lists."""
    size = F.size(tokens)
    count = F.greatest(size - n + 1, F.lit(0))
    runs = F.slice(tokens, F.lit(1), count)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(k + 1), count), lambda x, y: F.concat(x, F.lit(separator), y))
    return runs


def char_runs(text: Column, n: int) -> Column:
    """All runs of n characters of a string, found in one pass by looking ahead."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def char_ngram_counts(df: DataFrame, text: str, n: int) -> DataFrame:
    """(token, cnt) of runs of n characters that are no white space; separated by spaces after counting."""
    runs = frequencies(df, char_runs(F.regexp_replace(text, f"[{SPACE}]+", ""), n), "run")
    return runs.select(F.array_join(F.regexp_extract_all("run", F.lit("(?s)."), 0), " ").alias("token"), "cnt")


def frequencies(df: DataFrame, tokens: Column, name: str = "token") -> DataFrame:
    """(token, cnt) over all rows; partial sums before the shuffle."""
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias("cnt"))


def top(freq: DataFrame, k: int, name: str = "token") -> DataFrame:
    """The k most frequent; ties by token. A top-k of bounded rows, never a full sort."""
    return freq.orderBy(F.desc("cnt"), name).limit(k)


def rare(freq: DataFrame, most: int = 5, k: int = 20, name: str = "token") -> DataFrame:
    return freq.where(F.col("cnt") <= most).orderBy(name).limit(k)


def length_histogram(freq: DataFrame, name: str = "token") -> DataFrame:
    return freq.groupBy(F.length(name).cast("bigint").alias("length")).agg(F.sum("cnt").alias("cnt"))


def entropy(freq: DataFrame) -> DataFrame:
    """One row: entropy in bits and relative to that of equal shares (0 for a single type).

    One pass: H = log2(N) - sum(c log2 c) / N.
    """
    h = F.log2(F.sum("cnt").cast("double")) - F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))) / F.sum("cnt")
    return freq.agg(F.count("*").alias("types"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("tokens"), F.coalesce(h, F.lit(0.0)).alias("entropy")).withColumn(
        "diversity", F.when(F.col("types") > 1, F.col("entropy") / F.log2(F.col("types").cast("double"))).otherwise(0.0)
    )


def token_statistics(freq: DataFrame, name: str = "token", compound: Column | None = None) -> DataFrame:
    """One row of totals: tokens, types, mean length, script share of tokens and the number of compound types."""
    whole = compound if compound is not None else count(F.col(name), f"[{SCRIPT}]") > 2
    return freq.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
        F.count("*").alias("types"),
        F.coalesce(F.sum(F.length(name) * F.col("cnt")) / F.sum("cnt"), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.sum(F.when(F.col(name).rlike(f"^[{SCRIPT}]+$"), F.col("cnt")).otherwise(0)) / F.sum("cnt"), F.lit(0.0)).alias("script_share"),
        F.count_if(whole).alias("compounds"),
    )


def coverage(freq: DataFrame, name: str = "token", shares: tuple[int, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """(share, types): how many of the most frequent types cover each share of all tokens, in percent.

    Types are first counted by frequency, and the running sum goes over distinct frequencies, of which there are few:
    at most the square root of twice the number of tokens.
    """
    by = freq.groupBy("cnt").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    run = by.select("cnt", "n", F.coalesce(F.sum(F.col("cnt") * F.col("n")).over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("types_before"))
    total = freq.agg(F.sum("cnt").alias("total"))
    need = run.join(F.broadcast(total)).select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("need", F.col("share") * F.col("total") / 100)  # one row is broadcast
    hit = need.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("cnt") * F.col("n") >= F.col("need")))
    return hit.select("share", (F.col("types_before") + F.ceil((F.col("need") - F.col("before")) / F.col("cnt"))).cast("bigint").alias("types"))


def first_seen(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(token, first_doc, first_pos, cnt) of distinct tokens, in no order; sort by the first two for first-seen order."""
    each = df.select(F.col(doc).alias("doc"), F.posexplode(tokens).alias("pos", "token"))
    return each.groupBy("token").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("cnt")).select("token", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"), "cnt")
