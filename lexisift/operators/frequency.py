"""The syllable frequency model: counts by type, contexts, rarity, confidence, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexisift.functions import text as T
from lexisift.functions.scripts import DIGIT, SCRIPT, SPACE, segmenter
from lexisift.functions.segment import syllables


def typed_counts(tokens: DataFrame, name: str = "syllable") -> DataFrame:
    """(type, syllable, cnt, included) of one row for each token.

    The generators keep filters by type above the counts: Catalyst moves a filter that only names the group's key below
    the aggregate, where the type would be worked out for each token instead of each syllable.
    """
    counts = T.held(tokens.groupBy(name).agg(F.count("*").alias("cnt")), "type", T.syllable_type(name))
    return T.held(counts, "included", T.included(name, F.col("type")))


def merged(old: DataFrame, new: DataFrame, name: str = "syllable") -> DataFrame:
    """Count tables added up: training goes on from an earlier table."""
    return old.select(name, "cnt").unionByName(new.select(name, "cnt")).groupBy(name).agg(F.sum("cnt").alias("cnt"))


def rarity(cnt: Column, least: int = 2, rare: int = 10, common: int = 100) -> Column:
    """common, rare, uncommon or unknown (a syllable seen once is unknown)."""
    return F.when(cnt >= common, "common").when(cnt.between(least, rare), "rare").when(cnt >= least, "uncommon").otherwise("unknown")


def contexts(lists: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(syllable, prev, cnt): what stands before each syllable of a list."""
    lists = T.held(lists, tokens, F.col(tokens))
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(tokens), F.lit(2))), lambda i: F.struct(F.try_element_at(tokens, i - 1).alias("prev"), F.try_element_at(tokens, i).alias("syllable")))
    each = lists.select(F.explode(F.when(F.size(tokens) > 1, pairs)).alias("x"))
    return each.groupBy(F.col("x.syllable").alias("syllable"), F.col("x.prev").alias("prev")).agg(F.count("*").alias("cnt"))


def runs(lists: DataFrame, tokens: str, n: int) -> DataFrame:
    """(s1, ..., sn, cnt): the runs of n syllables of lists, each syllable a column of its own."""
    lists = T.held(lists, tokens, F.col(tokens))
    names = [f"s{k}" for k in range(1, n + 1)]
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.struct(*(F.try_element_at(tokens, i + k).alias(name) for k, name in enumerate(names))))
    return lists.select(F.explode(F.when(F.size(tokens) >= n, each)).alias("x")).groupBy(*(F.col(f"x.{k}").alias(k) for k in names)).agg(F.count("*").alias("cnt"))


def summary(counts: DataFrame, texts: int) -> DataFrame:
    """One row over (syllable, cnt): totals, the mean of a text and the entropy in bits."""
    n = F.sum("cnt")
    h = F.log2(n.cast("double")) - F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))) / n
    return counts.agg(n.alias("total_syllables"), F.count("*").alias("unique_syllables"), F.lit(texts).cast("bigint").alias("texts"), (n / F.lit(max(texts, 1))).alias("mean_of_text"), h.alias("entropy"))


def extremes(counts: DataFrame, k: int = 50, rare: int = 10) -> DataFrame:
    """(kind, rank, syllable, cnt): the k most common syllables and the first k of those that occur ``rare`` times or less."""
    w = Window.orderBy(F.desc("cnt"), "syllable")
    top = counts.orderBy(F.desc("cnt"), "syllable").limit(k).withColumn("rank", F.row_number().over(w)).select(F.lit("common").alias("kind"), "rank", "syllable", "cnt")
    w = Window.orderBy("cnt", "syllable")
    low = counts.where(F.col("cnt") <= rare).orderBy("cnt", "syllable").limit(k).withColumn("rank", F.row_number().over(w)).select(F.lit("rare").alias("kind"), "rank", "syllable", "cnt")
    return top.union(low)


def places(lists: DataFrame, tokens: str, fits: str) -> DataFrame:
    """(syllable, cnt, seen) of the syllables of lists that match ``fits``: how often each occurs, and how often behind another such one.

    Of each list only the beginning is looked through for its first fitting syllable; else the pattern is matched with
    each syllable once, not with each token.
    """
    lists = T.held(lists.select(tokens), tokens, F.col(tokens))
    fitting = lambda c: F.get(F.filter(c, lambda x: x.rlike(fits)), F.lit(0))
    head = F.array_position(F.col(tokens), F.coalesce(fitting(F.slice(tokens, 1, 8)), fitting(F.col(tokens)), F.lit("")))
    # Held below the tokens: beside a generator it would be worked out for each of them.
    each = T.held(lists, "head", head).select("head", F.posexplode(tokens).alias("pos", "syllable"))
    counts = each.groupBy("syllable").agg(F.count("*").alias("cnt"), F.count_if(F.col("pos") >= F.col("head")).alias("seen"))
    # A generator keeps the filter above the counts.
    return T.held(counts, "fits", F.col("syllable").rlike(fits)).where("fits").drop("fits")


def confidence(counts: DataFrame) -> DataFrame:
    """(syllable, cnt, confidence_score) of (syllable, cnt, seen): seven tenths by frequency, three by how often it has a context."""
    most = counts.agg(F.max("cnt").alias("most"))
    score = 0.7 * F.col("cnt") / F.col("most") + 0.3 * F.least(F.col("seen") / 100, F.lit(1.0))
    return counts.join(F.broadcast(most)).select("syllable", "cnt", score.alias("confidence_score"))  # one row is broadcast


def suggestions(unknown: DataFrame, known: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(syllable, rank, suggestion, similarity): known syllables that agree with an unknown one in over half of its places.

    ``least`` is one half or more. If over half of the places to the longer length are equal, two of them are next to
    each other or have one between them; so candidates come from an equi-join on a place and two of its characters,
    and no pair without such a place is formed.
    """

    def places(d: DataFrame, name: str) -> DataFrame:
        chars = d.select(F.col("syllable").alias(name), F.split("syllable", "").alias("a"))
        pair = lambda gap: F.transform(F.sequence(F.lit(1), F.size("a") - gap), lambda i: F.struct(i.alias("place"), F.element_at("a", i).alias("x"), F.element_at("a", i + gap).alias("y"), F.lit(gap).alias("gap")))
        none = F.array().cast("array<struct<place:int,x:string,y:string,gap:int>>")
        both = F.concat(*(F.when(F.size("a") > gap, pair(gap)).otherwise(none) for gap in (1, 2)))
        return chars.select(name, F.explode(both).alias("at")).select(name, "at.*")

    met = places(unknown, "syllable").join(places(known, "suggestion"), ["place", "x", "y", "gap"])
    n, m = F.length("syllable"), F.length("suggestion")
    pairs = met.where((F.least(n, m) > least * F.greatest(n, m)) & (F.col("syllable") != F.col("suggestion"))).select("syllable", "suggestion").distinct()
    equal = F.size(F.filter(F.zip_with(F.split("syllable", ""), F.split("suggestion", ""), lambda x, y: x == y), lambda x: x))
    close = pairs.withColumn("similarity", equal / F.greatest(n, m)).where(F.col("similarity") > least)
    w = Window.partitionBy("syllable").orderBy(F.desc("similarity"), "suggestion")
    return close.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("syllable", F.col("rank").cast("bigint").alias("rank"), "suggestion", "similarity")


def text_validity(texts: DataFrame, text: str, doc: str = "doc_id") -> DataFrame:
    """(doc, total, valid, validity_rate, unknown) of texts with syllables; valid ones are included and occur twice or more.

    A syllable that occurs once does so in one text, so the counts by syllable name it beside the count, and no
    syllable is looked up. Kinds that are left out have no letter of the script or are numbers, which stand in a text
    as whole runs; so these alone are taken out of a text once more, and its syllables are counted without a list.
    """
    texts = texts.select(doc, text)
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), "\u200b", "")
    tokens = texts.select(doc, F.explode(syllables(text)).alias("syllable"))
    once = tokens.groupBy("syllable").agg(F.count("*").alias("cnt"), F.min(doc).alias(doc)).where("cnt = 1")
    # A generator keeps the filter above the counts.
    once = T.held(once, "fits", F.col("syllable").rlike(T.COUNTED)).where("fits")
    alone = once.select(doc, F.lit(0).alias("total"), F.lit(1).alias("unknown"))
    lists = T.held(texts.select(doc, clean.alias(text)), "odd", F.regexp_extract_all(text, F.lit(rf"(?U)[^{SCRIPT}\s]+|[{DIGIT}]{{2,}}+"), 0))
    blank = F.size(F.filter("odd", lambda x: ~x.rlike(f"[^{SPACE}]")))
    left_out = F.size(F.filter("odd", lambda x: ~x.rlike(T.COUNTED)))
    whole = lists.select(doc, F.regexp_count(text, F.lit(segmenter("regex_advanced").replace(r"\s+|", "", 1))).alias("n"), blank.alias("blank"), left_out.alias("left_out"))
    sums = whole.select(doc, (F.col("n") - F.col("blank")).alias("total"), (F.col("left_out") - F.col("blank")).alias("unknown")).unionByName(alone)
    out = sums.groupBy(doc).agg(F.sum("total").alias("total"), F.sum("unknown").alias("unknown")).where("total > 0")
    valid = F.col("total") - F.col("unknown")
    return out.select(doc, "total", valid.alias("valid"), (valid / F.col("total")).alias("validity_rate"), "unknown")
