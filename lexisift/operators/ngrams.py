"""N-gram language models as tables: counts of n-grams and contexts, smoothing, scoring and error detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.arrays import starts
from lexisift.functions.scripts import SCRIPT, SPACE
from lexisift.functions.segment import syllables, valid_syllables
from lexisift.functions.text import count, held, model_text
from lexisift.operators.stats import char_runs, ngrams
from lexisift.sources.shared import stored

PAD = "<"
START, END = "<START>", "<END>"


def char_units(text: Column | str, n: int, least: float = 0.0) -> Column:
    """A text's script part with padding, as a string; empty for texts without."""
    pad = F.lit(PAD * (n - 1))
    return F.regexp_replace(F.concat(pad, model_text(text, least), pad), F.lit(f"^{PAD * (2 * n - 2)}$"), F.lit(""))


def runs(units: Column, n: int, separator: str) -> Column:
    """The n-grams of units: of a string's characters without separator, else of an array."""
    return ngrams(units, n, separator) if separator else char_runs(units, n)


def syllable_units(text: Column | str, n: int, method: str = "regex_advanced") -> Column:
    """Padded valid syllables of a text; empty for texts with fewer than n."""
    s = valid_syllables(syllables(text, method))
    padded = F.concat(F.array_repeat(F.lit(START), n - 1), s, F.array_repeat(F.lit(END), n - 1))
    return F.when(F.size(s) >= n, padded).otherwise(F.array().cast("array<string>"))


@dataclass
class Model:
    """Counts of n-grams (ngram, context, cnt) and contexts (context, cnt), and a row of sizes (vocabulary, total)."""

    n: int
    separator: str
    ngrams: DataFrame
    contexts: DataFrame
    sizes: DataFrame


#: Stands after the last unit of a list while n-grams are counted; no text holds it.
STOP = "\x00"


def _counts(units: DataFrame, column: str, n: int, separator: str) -> DataFrame:
    """(ngram, cnt) of units, a stop after the last one."""
    u = F.concat(F.col(column), F.array(F.lit(STOP))) if separator else F.when(F.length(column) > 0, F.concat(F.col(column), F.lit(STOP))).otherwise("")
    return held(units.select(column), column, u).select(F.explode(runs(F.col(column), n, separator)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("cnt"))


def train(units: DataFrame | None, column: str, n: int, separator: str, padding: tuple[str, ...] = (), counts: DataFrame | None = None) -> Model:
    """A model of lists of units, padded with n - 1 units at both ends. ``padding`` lists units that are no vocabulary.

    One reading and one shuffle count all: each n-gram begins with its context and ends with a unit, and a stop after
    the last unit makes the last context the beginning of an n-gram too. The counts are written once; the model's
    tables are views of them. counts: these (ngram, cnt), if several models were counted together (``counting.counted``).
    """
    grams = counts if counts is not None else stored(_counts(units, column, n, separator), "ngrams")
    if separator:
        context, unit = F.substring_index("ngram", separator, n - 1), F.substring_index("ngram", separator, -1)
    else:
        context, unit = F.expr("substr(ngram, 1, length(ngram) - 1)"), F.expr("substr(ngram, length(ngram), 1)")
    each = grams.select("ngram", context.alias("context"), unit.alias("unit"), "cnt")
    gram = each.where(F.col("unit") != STOP).select("ngram", "context", "cnt")
    contexts = each.groupBy("context").agg(F.sum("cnt").alias("cnt"))
    known = F.when(~F.col("unit").isin(STOP, *padding), F.col("unit"))
    sizes = each.agg(F.count_distinct(known).alias("vocabulary"), F.coalesce(F.sum(F.when(F.col("unit") != STOP, F.col("cnt"))), F.lit(0)).alias("total"))
    return Model(n, separator, gram, contexts, sizes)


def laplace(cnt: Column, context: Column, vocabulary: Column, total: Column, alpha: float = 1.0) -> Column:
    """Add-alpha; an unseen context is smoothed over the whole corpus."""
    return F.when(F.coalesce(context, F.lit(0)) > 0, (F.coalesce(cnt, F.lit(0)) + alpha) / (context + alpha * vocabulary)).otherwise(alpha / (total + alpha * vocabulary))


def backoff(cnt: Column, context: Column, vocabulary: Column, factor: float = 0.4) -> Column:
    return F.when((F.coalesce(cnt, F.lit(0)) > 0) & (F.coalesce(context, F.lit(0)) > 0), cnt / context).otherwise(factor / vocabulary)


def good_turing(grams: DataFrame) -> DataFrame:
    """(cnt, types, adjusted): adjusted counts by the frequencies of frequencies; a count without a next one stays."""
    f = grams.groupBy("cnt").agg(F.count("*").alias("types"))
    after = f.select((F.col("cnt") - 1).alias("cnt"), F.col("types").alias("after"))
    adjusted = F.when(F.col("after").isNotNull(), F.greatest((F.col("cnt") + 1) * F.col("after") / F.col("types"), F.col("cnt") * 0.1)).otherwise(F.col("cnt").cast("double"))
    return f.join(after, "cnt", "left").select("cnt", "types", adjusted.alias("adjusted"))


def probabilities(model: Model, method: str = "laplace") -> DataFrame:
    """model.ngrams with their smoothed probability."""
    joined = model.ngrams.join(model.contexts.withColumnRenamed("cnt", "context_cnt"), "context", "left").join(F.broadcast(model.sizes))  # one row is broadcast
    if method == "laplace":
        p = laplace(F.col("cnt"), F.col("context_cnt"), F.col("vocabulary"), F.col("total"))
    elif method == "simple_backoff":
        p = backoff(F.col("cnt"), F.col("context_cnt"), F.col("vocabulary"))
    elif method == "good_turing":
        joined = joined.join(good_turing(model.ngrams).select("cnt", "adjusted"), "cnt")
        p = F.col("adjusted") / F.col("context_cnt")
    else:
        raise ValueError(f"no smoothing method {method}")
    return joined.withColumn("probability", p)


def statistics(model: Model) -> DataFrame:
    """One row of sizes, coverage of the possible n-grams, entropy in bits and perplexity."""
    h = F.log2(F.sum("cnt").cast("double")) - F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))) / F.sum("cnt")
    out = model.ngrams.agg(F.count("*").alias("unique_ngrams"), F.coalesce(h, F.lit(0.0)).alias("entropy")).join(model.sizes)
    return out.select(F.lit(model.n).alias("n"), "vocabulary", "total", "unique_ngrams", (F.col("unique_ngrams") / F.pow(F.col("vocabulary").cast("double"), F.lit(model.n))).alias("coverage"), "entropy", F.pow(F.lit(2.0), F.col("entropy")).alias("perplexity"))


def filter_statistics(texts: DataFrame, text: str, least: float = 0.0) -> DataFrame:
    """One row: characters, the shares of the script, of what the filter takes out, of white space and of marks, and of texts kept.

    A text is kept if its share of the script among characters that are no white space reaches ``least`` and it has any.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    n = {"n": F.length(c), "s": count(c, f"[{SCRIPT}]"), "w": count(c, f"[{SPACE}]"), "p": count(c, "[។៕៖ៗ]")}
    each = texts.select(*(v.cast("bigint").alias(k) for k, v in n.items()))
    total = F.sum("n")
    share = lambda x, name: F.coalesce(F.sum(x) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(name)
    kept = F.count_if((F.col("s") >= least * (F.col("n") - F.col("w"))) & (F.col("n") > F.col("w"))) / F.count("*")
    return each.agg(total.alias("total_chars"), share(F.col("s"), "khmer_ratio"), share(F.col("n") - F.col("s") - F.col("w"), "filter_ratio"), share(F.col("w"), "space_ratio"), share(F.col("p"), "punct_ratio"), kept.alias("text_retention_ratio"))


def smoothing_statistics(model: Model) -> DataFrame:
    """One row for each smoothing method: the probability of an unseen n-gram and the coverage."""
    one = model.ngrams.agg(F.count_if(F.col("cnt") == 1).alias("once")).join(model.sizes)
    v, n = F.col("vocabulary"), F.col("total")
    rows = F.array(
        F.struct(F.lit("laplace").alias("method"), (1.0 / (n + v)).alias("unseen_probability"), (n / (n + v)).alias("coverage")),
        F.struct(F.lit("good_turing").alias("method"), F.when(F.col("once") > 0, F.col("once") / n).otherwise(1.0 / (n + v)).alias("unseen_probability"), (1 - F.col("once") / n).alias("coverage")),
        F.struct(F.lit("simple_backoff").alias("method"), (0.4 / v).alias("unseen_probability"), F.lit(0.6).alias("coverage")),
    )
    return one.select("vocabulary", "total", F.explode(rows).alias("x")).select("x.method", F.col("vocabulary").alias("vocabulary_size"), F.col("total").alias("total_ngrams"), "x.unseen_probability", "x.coverage")


def scored(texts: DataFrame, key: str, units: Column, model: Model, method: str = "laplace") -> DataFrame:
    """(key, pos, ngram, probability) of every n-gram of every text, by a smoothing method.

    The texts' n-grams are joined with counts, both sides by equal keys; the sizes are one row. Good-Turing gives an
    unseen n-gram the adjusted count of none, the share of n-grams seen once, over its context's count; after an
    unseen context that share itself. Backoff gives both the factor over the vocabulary.
    """
    each = held(texts.select(key, units.alias("units")), "units", F.col("units")).select(key, F.posexplode(runs(F.col("units"), model.n, model.separator)).alias("pos", "ngram"))
    cut = F.substring_index("ngram", model.separator, model.n - 1) if model.separator else F.expr("substr(ngram, 1, length(ngram) - 1)")
    each = each.withColumn("context", cut)
    joined = each.join(model.ngrams.select("ngram", "cnt"), "ngram", "left").join(model.contexts.withColumnRenamed("cnt", "context_cnt"), "context", "left").join(F.broadcast(model.sizes))
    if method == "laplace":
        p = laplace(F.col("cnt"), F.col("context_cnt"), F.col("vocabulary"), F.col("total"))
    elif method == "simple_backoff":
        p = backoff(F.col("cnt"), F.col("context_cnt"), F.col("vocabulary"))
    elif method == "good_turing":
        once = model.ngrams.agg(F.count_if(F.col("cnt") == 1).alias("once"))  # one row is broadcast
        joined = joined.join(good_turing(model.ngrams).select("cnt", "adjusted"), "cnt", "left").crossJoin(F.broadcast(once))
        none = F.when(F.col("once") > 0, F.col("once") / F.col("total")).otherwise(1.0 / (F.col("total") + F.col("vocabulary")))
        p = F.when(F.coalesce("context_cnt", F.lit(0)) > 0, F.coalesce("adjusted", none) / F.col("context_cnt")).otherwise(none)
    else:
        raise ValueError(f"no smoothing method {method}")
    return joined.select(key, "pos", "ngram", p.alias("probability"))


def text_scores(texts: DataFrame, key: str, each: DataFrame, text: str = "text") -> DataFrame:
    """(key, log_probability, n_ngrams): mean natural logarithms; 0 for empty text, -inf for a text without n-grams."""
    p = F.when(F.col("probability") > 0, F.col("probability")).otherwise(1e-10)
    sums = each.groupBy(key).agg(F.avg(F.ln(p)).alias("mean"), F.count("*").alias("n_ngrams"))
    value = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.coalesce("mean", F.lit(float("-inf"))))
    return texts.join(sums, key, "left").select(key, value.alias("log_probability"), F.coalesce("n_ngrams", F.lit(0)).alias("n_ngrams"))


def char_errors(each: DataFrame, texts: DataFrame, key: str, text: str, n: int, threshold: float = 0.001) -> DataFrame:
    """(key, start, end, ngram, confidence) of improbable n-grams; places are in the script part of the text."""
    size = texts.select(key, F.length(text).alias("size"))
    start = F.greatest(F.lit(0), F.col("pos") - (n - 1))
    bad = each.where(F.col("probability") < threshold).join(size, key)
    return bad.select(key, "pos", start.alias("start"), F.least(F.col("size"), start + n).alias("end"), "ngram", (1 - F.col("probability") / threshold).alias("confidence"))


def error_summary(each: DataFrame, key: str, threshold: float = 0.001, most: int = 10) -> DataFrame:
    """(key, n_ngrams, n_errors, overall_score, average_probability, min_probability, suspicious): one row for each text with n-grams."""
    bad = F.col("probability") < threshold
    first = F.slice(F.array_sort(F.collect_list(F.when(bad, F.struct("pos", "ngram")))), 1, most)
    return each.groupBy(key).agg(
        F.count("*").alias("n_ngrams"), F.count_if(bad).alias("n_errors"), (1 - F.count_if(bad) / F.count("*")).alias("overall_score"), F.avg("probability").alias("average_probability"), F.min("probability").alias("min_probability"), F.transform(first, lambda x: x["ngram"]).alias("suspicious")
    )


def syllable_errors(texts: DataFrame, key: str, text: str, each: DataFrame, vocabulary: DataFrame, n: int, threshold: float = 0.001) -> DataFrame:
    """(key, pos, start, end, syllable, confidence, kind): the syllable an improbable n-gram blames.

    The blamed syllable is the n-gram's own place plus n - 1, at most the last (padding is not taken off, as in the
    model's source). kind is suspicious for syllables outside ``vocabulary`` (token), else invalid_sequence.
    """
    kept = held(texts.select(key, text), "s", valid_syllables(syllables(text))).select(key, "s", starts(F.transform("s", F.length)).alias("starts"))
    bad = each.where(F.col("probability") < threshold).join(kept, key).withColumn("at", F.least(F.col("pos") + n - 1, F.size("s") - 1))
    out = bad.withColumns({"syllable": F.get("s", F.col("at")), "start": F.get("starts", F.col("at"))}).drop("s", "starts")
    out = out.join(vocabulary.select(F.col("token").alias("syllable"), F.lit(True).alias("known")), "syllable", "left")
    return out.select(key, "pos", "start", (F.col("start") + F.length("syllable")).alias("end"), "syllable", (1 - F.col("probability") / threshold).alias("confidence"), F.when(F.col("known"), "invalid_sequence").otherwise("suspicious").alias("kind"))


def not_blank(c: Column) -> Column:
    return c.rlike(f"[^{SPACE}]")
