"""Vocabularies, encoding, training windows and perplexities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexisift.functions.scripts import SCRIPT

PAD, UNK, SOS, EOS = 0, 1, 2, 3


def build(freq: DataFrame, token: str = "token", least: int = 2, most: int = 10_000, script_only: bool = False) -> DataFrame:
    """(token, id, cnt): ids from 4 on by frequency, ties by token; at most ``most`` ids with the special ones.

    The most frequent are taken first, by a bounded top-k, and only these are numbered. script_only leaves out tokens
    with other characters than the script's.
    """
    if script_only:
        freq = freq.where(F.col(token).rlike(rf"^[{SCRIPT}]+\z"))
    top = freq.where(F.col("cnt") >= least).orderBy(F.desc("cnt"), token).limit(most - 4)
    return top.select(F.col(token).alias("token"), (F.row_number().over(Window.orderBy(F.desc("cnt"), token)) + 3).alias("id"), "cnt")


def info(vocabulary: DataFrame, k: int = 10) -> DataFrame:
    """(kind, name, n): how many tokens there are of each length, and the k most frequent tokens with their counts."""
    lengths = vocabulary.groupBy(F.length("token").alias("l")).agg(F.count("*").alias("n")).select(F.lit("length").alias("kind"), F.col("l").cast("string").alias("name"), "n")
    top = vocabulary.orderBy(F.desc("cnt"), "token").limit(k).select(F.lit("frequent").alias("kind"), F.col("token").alias("name"), F.col("cnt").alias("n"))
    return lengths.union(top)


def token_info(tokens: DataFrame, freq: DataFrame, vocabulary: DataFrame, script: Column) -> DataFrame:
    """(token, id, cnt, known, script) of distinct tokens: the id is -1 outside the vocabulary."""
    out = tokens.select("token").distinct().join(freq.select("token", "cnt"), "token", "left").join(vocabulary.select("token", "id"), "token", "left")
    return out.select("token", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.col("id").isNotNull().alias("known"), script.alias("script"))


def split(df: DataFrame, *keys: str, share: int = 80) -> DataFrame:
    """``df`` with ``part``, train or valid, by a digest of the keys: the same rows always fall to the same side."""
    n = F.conv(F.substring(F.md5(F.concat_ws("-", *(F.col(k).cast("string") for k in keys))), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("part", F.when(n < share, "train").otherwise("valid"))


def coverage(freq: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """One row: the shares of occurrences and of types that the vocabulary holds."""
    marked = freq.join(vocabulary.select(F.col("token").alias(token), "id"), token, "left")
    kept = F.col("id").isNotNull()
    return marked.agg((F.sum(F.when(kept, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("occurrences"), (F.count_if(kept) / F.count("*")).alias("types"))


def _entries(vocabulary: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Tokens and ids of a vocabulary on the driver: ``build`` bounds how many there are."""
    rows = vocabulary.select("token", "id").orderBy("id").collect()
    return pa.array([r["token"] for r in rows], pa.string()), pa.array([r["id"] for r in rows], pa.int32())


def encoder(vocabulary: DataFrame, length: int):
    """A column function: an array of tokens as ``length`` ids, unknown ones as 1, filled up with 0; null counts as empty."""
    tokens, ids = _entries(vocabulary)

    @F.pandas_udf("array<int>")
    def coded(lists: pd.Series) -> pd.Series:
        firsts = [list(x[:length]) if x is not None else [] for x in lists]
        sizes = np.array([len(x) for x in firsts], np.int64)
        at = pc.index_in(pa.array([t for x in firsts for t in x], pa.string()), value_set=tokens)
        flat = pc.fill_null(ids.take(at), UNK).to_numpy(zero_copy_only=False)
        out = np.full((len(firsts), length), PAD, np.int32)
        rows = np.repeat(np.arange(len(firsts)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return pd.Series(list(out))

    return coded


def decoder(vocabulary: DataFrame, keep_unknown: bool = True, stop_at_padding: bool = False):
    """A column function: ids as their tokens joined. Special ids are skipped, unknown ones show as <UNK> if kept.

    stop_at_padding: a character vocabulary's text ends at its first padding and shows no unknown ones.
    """
    tokens, ids = _entries(vocabulary)
    names = dict(zip(ids.to_pylist(), tokens.to_pylist()))
    other = "<UNK>" if keep_unknown and not stop_at_padding else ""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        def one(x) -> str:
            x = [] if x is None else list(x)
            if stop_at_padding and PAD in x:
                x = x[: x.index(PAD)]
            return "".join(names.get(int(i), other) for i in x if i not in (PAD, SOS, EOS))

        return lists.map(one)

    return text


def encode(lists: DataFrame, key: str, tokens: str, vocabulary: DataFrame, length: int) -> DataFrame:
    """(key, ids): the first ``length`` tokens as ids. The vocabulary goes to the tasks, rows stay where they are."""
    return lists.select(key, encoder(vocabulary, length)(tokens).alias("ids"))


def decode(encoded: DataFrame, key: str, vocabulary: DataFrame, ids: str = "ids", keep_unknown: bool = True, stop_at_padding: bool = False) -> DataFrame:
    """(key, text): tokens joined."""
    return encoded.select(key, decoder(vocabulary, keep_unknown, stop_at_padding)(ids).alias("text"))


def windows(tokens: Column, length: int) -> Column:
    """Windows of ``length`` tokens, each half a length on; a list no longer than one has none."""
    last = F.size(tokens) - length - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(max(length // 2, 1)))
    return F.when(last >= 0, F.transform(starts, lambda i: F.slice(tokens, i + 1, length))).otherwise(F.array().cast("array<array<string>>"))


def perplexities(scored: DataFrame, key: str) -> DataFrame:
    """(key, pos, perplexity) of scored n-grams, at most 1e10."""
    return scored.select(key, "pos", (1 / F.greatest("probability", F.lit(1e-10))).alias("perplexity"))


def sequence_perplexity(each: DataFrame, key: str) -> DataFrame:
    """(key, perplexity): the geometric mean."""
    return each.groupBy(key).agg(F.exp(F.avg(F.ln("perplexity"))).alias("perplexity"))


def anomalies(each: DataFrame, key: str, factor: float = 2.0) -> DataFrame:
    """(key, pos, perplexity) beyond the median plus ``factor`` times the way to the upper quartile; three places at least."""
    q = each.groupBy(key).agg(F.count("*").alias("n"), F.expr("percentile(perplexity, 0.5)").alias("median"), F.expr("percentile(perplexity, 0.75)").alias("upper"))
    return each.join(q, key).where((F.col("n") >= 3) & (F.col("perplexity") > F.col("median") + factor * (F.col("upper") - F.col("median")))).select(key, "pos", "perplexity")
