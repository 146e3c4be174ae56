"""Fusing a neural scorer with the statistical ensemble. The scorer is any table of P(next | context); the n-gram model is the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def confidence(perplexity: Column) -> Column:
    return 1 / (1 + perplexity / 10)


def validated(perplexities: DataFrame, anomalies: DataFrame, key: str, most: float = 50.0) -> DataFrame:
    """(key, perplexity, n_anomalies, confidence, neural_valid): valid under ``most`` and without anomalies."""
    n = anomalies.groupBy(key).agg(F.count("*").alias("n_anomalies"))
    out = perplexities.join(n, key, "left").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))
    return out.select(key, "perplexity", "n_anomalies", confidence(F.col("perplexity")).alias("confidence"), ((F.col("perplexity") < most) & (F.col("n_anomalies") == 0)).alias("neural_valid"))


#: Default weights and thresholds of fusing: shares of both sources, and what each must reach to count.
NEURAL_SHARE, STATISTICAL_SHARE = 0.3, 0.7
NEURAL_LEAST, STATISTICAL_LEAST, COMBINED_LEAST, MOST_PERPLEXITY = 0.6, 0.7, 0.65, 100.0
STRATEGIES = ("weighted_average", "confidence_based", "majority_vote")


def fused_score(neural: Column, statistical: Column, strategy: str = "weighted_average", weight: float = NEURAL_SHARE, neural_least: float = NEURAL_LEAST, statistical_least: float = STATISTICAL_LEAST) -> Column:
    """One confidence of both by a strategy, within 0 and 1; a strategy of another name is the weighted average.

    weighted_average: by the shares. confidence_based: each weighted by itself, 0 if both are 0. majority_vote: the
    mean if both reach their thresholds, the one that does if one does, else the lower one.
    """
    if strategy == "confidence_based":
        total = neural + statistical
        score = F.when(total > 0, (neural * neural + statistical * statistical) / total).otherwise(0.0)
    elif strategy == "majority_vote":
        a, b = neural >= neural_least, statistical >= statistical_least
        score = F.when(a & b, (neural + statistical) / 2).when(a, neural).when(b, statistical).otherwise(F.least(neural, statistical))
    else:
        score = weight * neural + (1 - weight) * statistical
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def fused_validity(combined: Column, perplexity: Column, neural: Column, neural_valid: Column, statistical: Column, statistical_valid: Column, strategy: str = "weighted_average") -> Column:
    """Whether a text is valid by both sources, given their confidences and own verdicts."""
    sure, also = neural >= NEURAL_LEAST, statistical >= STATISTICAL_LEAST
    a, b = neural_valid & sure, statistical_valid & also
    if strategy == "majority_vote":
        agreed = a | b
    elif strategy == "confidence_based":
        agreed = F.when(sure & also, a & b).otherwise(a | b)
    else:
        agreed = F.lit(True)
    return (combined >= COMBINED_LEAST) & (perplexity <= MOST_PERPLEXITY) & agreed


def hybrid(neural: DataFrame | None, statistical: DataFrame, key: str, strategy: str = "weighted_average") -> DataFrame:
    """(key, neural_confidence, statistical_confidence, combined, is_valid, method) of the texts of ``statistical``.

    neural has (key, perplexity, confidence, neural_valid), statistical (key, confidence, valid). A text that the
    neural source has nothing on, or all without that source, falls back to the statistical verdict.
    """
    s = statistical.select(key, F.col("confidence").alias("statistical_confidence"), F.col("valid").alias("statistical_valid"))
    if neural is None:
        both = s.withColumns({"neural_confidence": F.lit(None).cast("double"), "perplexity": F.lit(None).cast("double"), "neural_valid": F.lit(None).cast("boolean")})
    else:
        both = s.join(neural.select(key, F.col("confidence").alias("neural_confidence"), "perplexity", "neural_valid"), key, "left")
    n, c = F.col("neural_confidence"), F.col("statistical_confidence")
    both = both.withColumn("combined", F.when(n.isNotNull(), fused_score(n, c, strategy)))
    valid = fused_validity(F.col("combined"), F.col("perplexity"), n, F.col("neural_valid"), c, F.col("statistical_valid"), strategy)
    return both.select(key, "neural_confidence", "statistical_confidence", "combined", F.when(n.isNull(), F.col("statistical_valid")).otherwise(valid).alias("is_valid"), F.when(n.isNull(), "statistical_fallback").otherwise("hybrid").alias("method"))


def performance(results: DataFrame, *by: str) -> DataFrame:
    """One row over hybrid results, or one for each value of ``by``: counts, the share of valid texts and mean confidences of those above 0."""
    above = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    valid = F.count_if("is_valid")
    return results.groupBy(*by).agg(F.count("*").alias("texts"), valid.alias("valid_texts"), (valid / F.count("*")).alias("validation_rate"), above("neural_confidence"), above("statistical_confidence"), F.avg("combined").alias("mean_combined"))


def fused_errors(neural: DataFrame, statistical: DataFrame, key: str, strategy: str = "union", neural_least: float = NEURAL_LEAST, statistical_least: float = STATISTICAL_LEAST) -> DataFrame:
    """(key, position, source, confidence) of two error tables (key, position, confidence) by a strategy.

    union keeps all rows of both, intersection those at places that both flag, confidence_weighted those that reach
    their source's threshold; a strategy of another name is the union.
    """
    both = neural.select(key, "position", F.lit("neural").alias("source"), "confidence").unionByName(statistical.select(key, "position", F.lit("statistical").alias("source"), "confidence"))
    if strategy == "intersection":
        common = both.groupBy(key, "position").agg(F.count_distinct("source").alias("n")).where("n = 2").select(key, "position")
        return both.join(common, [key, "position"], "left_semi")
    if strategy == "confidence_weighted":
        return both.where(F.col("confidence") >= F.when(F.col("source") == "neural", neural_least).otherwise(statistical_least))
    return both


def merged_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, position, segment, type, confidence, description) of error rows with an order ``ord``, folded place by place.

    A later error takes the place if it is more than a tenth more confident than the one there; one less than a tenth
    away is merged: the place's description names its source too and the larger confidence stays; others are dropped.
    A place's errors are as many as the models that look at it.
    """
    item = F.struct("ord", "type", "confidence", "description", "source")
    lists = rows.groupBy(key, "position", "segment").agg(F.sort_array(F.collect_list(item)).alias("es"))
    first = F.element_at("es", 1)
    start = F.struct(first["type"].alias("type"), first["confidence"].alias("confidence"), first["description"].alias("description"))

    def step(s, e):
        over = e["confidence"] > 1.1 * s["confidence"]
        near = F.abs(e["confidence"] - s["confidence"]) < 0.1
        return F.struct(
            F.when(over, e["type"]).otherwise(s["type"]).alias("type"),
            F.when(over, e["confidence"]).when(near, F.greatest(e["confidence"], s["confidence"])).otherwise(s["confidence"]).alias("confidence"),
            F.when(over, e["description"]).when(near, F.concat(s["description"], F.lit(" (also detected by "), e["source"], F.lit(")"))).otherwise(s["description"]).alias("description"),
        )

    return lists.select(key, "position", "segment", F.aggregate(F.slice("es", 2, F.greatest(F.size("es") - 1, F.lit(0))), start, step).alias("x")).select(key, "position", "segment", "x.*")


def final_score(scores: dict[str, Column], weights: dict[str, float], agreement: Column, n_errors: Column, least: float = 0.65) -> tuple[Column, Column]:
    """The integrated score of the sources that are present, times one half to one by agreement; and whether the text is valid."""
    total = sum((F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    mean = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in scores.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    score = F.coalesce(mean, F.lit(0.0)) * (0.5 + 0.5 * F.coalesce(agreement, F.lit(1.0)))
    return score, (n_errors == 0) & (score >= least)


def next_units(model, k: int = 20, temperature: float = 1.0) -> DataFrame:
    """(context, rank, unit, probability): the ``k`` likeliest units after each context, as a softmax of their log counts over these.

    Ties go to the smaller unit. A temperature below 1 makes the likely ones likelier.
    """
    cut = F.substring_index("ngram", model.separator, -1) if model.separator else F.expr("substr(ngram, length(ngram), 1)")
    w = Window.partitionBy("context").orderBy(F.desc("cnt"), "unit")
    top = model.ngrams.select("context", cut.alias("unit"), "cnt").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    share = F.pow(F.col("cnt").cast("double"), F.lit(1 / temperature))
    return top.select("context", "rank", "unit", (share / F.sum(share).over(Window.partitionBy("context"))).alias("probability"))


def corrections(errors: DataFrame, texts: DataFrame, key: str, text: str, model, most: int = 3, least: float = 0.1, top: int = 20, context: int = 5) -> DataFrame:
    """(key, position, rank, suggestion, probability): what a character model would rather have at each flagged place.

    errors has (key, position), places in the text. A place needs ``context`` characters before it; of the ``top``
    likeliest characters after these, those of probability ``least`` or more that differ from the text's own count.
    """
    n = model.n - 1
    spots = errors.select(key, "position").distinct().join(texts.select(key, F.col(text).alias("t")), key)
    spots = spots.where((F.col("position") >= context) & (F.col("position") < F.length("t"))).select(key, "position", F.expr(f"substr(t, position - {n} + 1, {n})").alias("context"), F.expr("substr(t, position + 1, 1)").alias("own"))
    w = Window.partitionBy("context").orderBy(F.desc("probability"), "unit")
    ranked = model.ngrams.join(model.contexts.withColumnRenamed("cnt", "all"), "context").select("context", F.expr("substr(ngram, length(ngram), 1)").alias("unit"), (F.col("cnt") / F.col("all")).alias("probability"))
    ranked = ranked.where((F.col("probability") >= least) & (F.col("unit") != "<")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    found = spots.join(ranked, "context").where("unit <> own")
    order = Window.partitionBy(key, "position").orderBy("place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "position", F.col("rank").cast("bigint").alias("rank"), F.col("unit").alias("suggestion"), "probability")


def char_perplexities(scored: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, perplexity) of each character of a text, of scored n-grams that end at places ``pos``.

    1 / P, at most 1e10; the first character has the second one's; texts of fewer than two characters have 1 throughout.
    """
    size = texts.select(key, F.length(text).alias("size"))
    each = scored.select(key, "pos", (1 / F.greatest("probability", F.lit(1e-10))).alias("perplexity")).join(size, key).where((F.col("pos") < F.col("size")) & (F.col("size") > 1) & (F.col("pos") > 0))
    both = F.when(F.col("pos") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("pos")))
    one = size.where("size = 1").select(key, F.lit(0).alias("pos"), F.lit(1.0).alias("perplexity"))
    return each.select(key, F.explode(both).alias("pos"), "perplexity").unionByName(one)


def anomaly_summary(anomalies: DataFrame, perplexities: DataFrame, key: str) -> DataFrame:
    """(key, n_errors, mean_perplexity, positions) of each text: how many anomalies it has, how strong, and where (in order)."""
    some = anomalies.groupBy(key).agg(F.count("*").alias("n_errors"), F.avg("perplexity").alias("mean_perplexity"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return perplexities.select(key).distinct().join(some, key, "left").select(key, F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("mean_perplexity", F.lit(0.0)).alias("mean_perplexity"), F.coalesce("positions", F.array().cast("array<int>")).alias("positions"))


def weight_sweep(rows: DataFrame, key: str, steps: int = 9) -> DataFrame:
    """(weight, mean_score) of the weighted average of neural and statistical for weights from .1 to .9."""
    grid = rows.select(key, "neural", "statistical", F.explode(F.array(*(F.lit(round(0.1 * k, 1)) for k in range(1, steps + 1)))).alias("weight"))
    return grid.groupBy("weight").agg(F.avg(F.col("weight") * F.col("neural") + (1 - F.col("weight")) * F.col("statistical")).alias("mean_score"))
