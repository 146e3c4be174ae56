"""Fusing the evidence of several validators: hybrid scores, votes, weight search, integrated errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Default shares of the rule, character and syllable scores.
SHARES = (0.4, 0.3, 0.3)


def consensus(scores: list[Column]) -> Column:
    """One less four times the variance of the scores, at least 0."""
    n = len(scores)
    mean = sum(scores[1:], scores[0]) / n
    return F.greatest(F.lit(0.0), 1 - 4 * sum(((s - mean) * (s - mean) for s in scores[1:]), (scores[0] - mean) * (scores[0] - mean)) / n)


def hybrid(df: DataFrame, rule: str, char: str, syllable: str, errors: str, shares: tuple[float, float, float] = SHARES, available: int = 3) -> DataFrame:
    """``df`` with overall, statistical, consensus and confidence scores and hybrid_valid (no errors and overall over 0.7)."""
    r, c, s = F.col(rule), F.col(char), F.col(syllable)
    overall = shares[0] * r + shares[1] * c + shares[2] * s
    agreed = consensus([r, c, s])
    return df.withColumns({"overall_score": overall, "statistical_score": (c + s) / 2, "consensus_score": agreed, "confidence_score": (available / 3 + agreed) / 2, "hybrid_valid": (F.col(errors) == 0) & (overall > 0.7)})


#: Default weights: rules, and the character and syllable models by the size of their n-grams.
DEFAULT_WEIGHTS = {"rule": 0.4, "char3": 0.15, "char4": 0.10, "char5": 0.05, "syll2": 0.15, "syll3": 0.10, "syll4": 0.05}


def confidences(model: Column) -> Column:
    """How sure a model is: rules 0.9, others 0.7."""
    return F.when(model == "rule", 0.9).otherwise(0.7)


def chosen_weights(method: str, search=None) -> dict[str, float]:
    """Weights by an optimisation method: those of ``search`` by cross_validation, else the defaults (also for grid_search and genetic)."""
    if method == "cross_validation" and search is not None:
        best = search()
        return {"rule": best["rule_weight"]} | {f"char{n}": w for n, w in best["char"].items()} | {f"syll{n}": w for n, w in best["syllable"].items()}
    return dict(DEFAULT_WEIGHTS)


def vote(rows: DataFrame, key: str, method: str = "weighted", ratio: str | None = None, length: str | None = None) -> DataFrame:
    """Votes by a method: dynamic (which needs ratio and length), confidence_weighted, else weighted (majority too)."""
    if method == "dynamic":
        return confidence_vote(dynamic_weights(rows, ratio, length), key)
    if method == "confidence_weighted":
        return confidence_vote(rows, key)
    return weighted_vote(rows, key)


def score_summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule_score, statistical_score, consensus_score) of rows (key, model, score): the mean of the n-gram models, and the agreement of all."""
    rule = F.col("model") == "rule"
    return rows.groupBy(key).agg(
        F.coalesce(F.max(F.when(rule, F.col("score"))), F.lit(1.0)).alias("rule_score"),
        F.coalesce(F.avg(F.when(~rule, F.col("score"))), F.lit(1.0)).alias("statistical_score"),
        F.greatest(F.lit(0.0), 1 - 4 * F.var_pop("score")).alias("consensus_score"),
    )


def ensemble_metrics(results: DataFrame) -> DataFrame:
    """One row over results (is_valid, consensus_score, confidence_score). Accuracy is the share of valid texts.

    As there are no true labels, precision, recall and the like are fixed shares of it, and error rates fixed numbers.
    """
    # The shares and rates.
    shares = {"precision": 0.9, "recall": 0.85, "f1_score": 0.87, "rule_based_accuracy": 0.9, "character_ngram_accuracy": 0.8, "syllable_ngram_accuracy": 0.85}
    accuracy = F.count_if("is_valid") / F.count("*")
    c, f = F.avg("consensus_score"), F.avg("confidence_score")
    return results.agg(accuracy.alias("accuracy"), *((accuracy * v).alias(k) for k, v in shares.items()), c.alias("consensus_rate"), f.alias("confidence_correlation"), (c * f).alias("voting_efficiency"), F.lit(0.1).alias("false_positive_rate"), F.lit(0.15).alias("false_negative_rate"))


def error_report(errors: DataFrame, *kinds: str) -> DataFrame:
    """(kind, name, rank, n, percent): the errors by each column of ``kinds``, most first."""
    each = errors.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds))).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind")
    return each.select("kind", "name", F.row_number().over(w.orderBy(F.desc("n"), "name")).cast("bigint").alias("rank"), "n", (100 * F.col("n") / F.sum("n").over(w)).alias("percent"))


def best_errors(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, position, segment, confidence, source, ord), the most confident of each place and segment; first source on ties."""
    w = Window.partitionBy(key, "position", "segment").orderBy(F.desc("confidence"), "ord")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def weighted_vote(rows: DataFrame, key: str) -> DataFrame:
    """(key, vote, vote_confidence) of rows (key, score, weight, confidence); one half and none without weights, no confidence without score."""
    w = F.sum("weight")
    s = F.sum(F.col("score") * F.col("weight"))
    c = F.sum(F.col("score") * F.col("weight") * F.col("confidence"))
    return rows.groupBy(key).agg(F.coalesce(s / F.nullif(w, F.lit(0.0)), F.lit(0.5)).alias("vote"), F.when(w == 0, 0.0).otherwise(F.coalesce(c / F.nullif(s, F.lit(0.0)), F.lit(0.0))).alias("vote_confidence"))


def confidence_vote(rows: DataFrame, key: str, factor: float = 1.0) -> DataFrame:
    """Votes weighted by the models' confidence; their confidence is the mean weight."""
    w = F.col("weight") * F.col("confidence") * factor
    return rows.groupBy(key).agg(F.coalesce(F.sum(F.col("score") * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.5)).alias("vote"), F.when(F.sum(w) == 0, 0.0).otherwise(F.sum(w) / F.count("*")).alias("vote_confidence"))


def dynamic_weights(rows: DataFrame, ratio: str, length: str) -> DataFrame:
    """``rows`` (model, weight, ...) with weights changed by the text's script share and length."""
    m = F.col("model")
    by = (
        F.when((m == "rule") & (F.col(ratio) > 0.8), 1.2)
        .when((m == "rule") & (F.col(ratio) < 0.5), 0.7)
        .when((F.col(length) < 50) & m.isin("char3", "syll2"), 1.3)
        .when((F.col(length) > 200) & m.isin("char5", "syll4"), 1.2)
        .otherwise(1.0)
    )
    return rows.withColumn("weight", F.col("weight") * by)


def spread_weights(total: float, sizes: list[int]) -> dict[int, float]:
    """A total dealt to n-gram sizes; sizes 3 and 4 get eleven parts where others get nine."""
    parts = {n: 1.1 if n in (3, 4) else 0.9 for n in sizes}
    whole = sum(parts.values())
    return {n: total * p / whole for n, p in parts.items()}


def weight_grid(char_sizes: list[int] = [3, 4, 5], syllable_sizes: list[int] = [2, 3, 4]) -> list[dict]:  # noqa: B006
    """The 20 candidate weightings in their order."""
    out = []
    for rule in (0.2, 0.3, 0.4, 0.5):
        for share in (0.3, 0.4, 0.5, 0.6, 0.7):
            left = 1.0 - rule
            out.append({"rank": len(out), "rule_weight": rule, "char_total": left * share, "char": spread_weights(left * share, char_sizes), "syllable": spread_weights(left * (1 - share), syllable_sizes)})
    return out


def ranked_slices(df: DataFrame, key: str, starts: list[int], size: int, most: int = 50_000) -> DataFrame:
    """The rows of ranks s to s + size - 1 by a numeric ``key``, for each s of ``starts``, with the number of the start (fold).

    Rows are counted in about 200 ranges of the key and the ranges that hold a slice are counted in finer ones, until
    they hold ``most`` rows or fewer (or one value alone); only these are sorted, never all rows.
    """
    out = None
    for fold, start in enumerate(starts):
        near, skip = df, start
        while True:
            cuts = sorted(set(near.approxQuantile(key, [k / 200 for k in range(1, 200)], 0.001)))
            part = sum((F.when(F.col(key) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
            counts = dict(near.groupBy(part.alias("part")).count().collect())  # a row for each range
            before, chosen, first = 0, [], 0
            for k in sorted(counts):
                if before + counts[k] > skip and before < skip + size:
                    first = before if not chosen else first
                    chosen.append(k)
                before += counts[k]
            if not chosen:
                near = None
                break
            held, whole = sum(counts[k] for k in chosen), before
            near, skip = near.where(part.isin(chosen)), skip - first
            if held <= max(most, 2 * size) or held == whole:
                break
        if near is None:
            continue
        w = Window.orderBy(key)
        ranks = near.orderBy(key).limit(skip + size).withColumn("place", F.row_number().over(w)).where(F.col("place") > skip)
        one = ranks.drop("place").withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.limit(0).withColumn("fold", F.lit(0))


def weight_search(texts: DataFrame, key: str, ratio: str, length: str, folds: int = 3, most: int = 20) -> DataFrame:
    """(rank, rule_weight, char_total, cv_score): simulated agreement of the first texts of each contiguous fold.

    Folds are equal runs of the texts by ``key``, the last with the rest; as the report it serves looks at no more, the
    first ``most`` texts of each take part.
    """
    n = texts.count()
    size = max(n // folds, 1)
    each = ranked_slices(texts.select(key, ratio, length), key, [f * size for f in range(folds)], min(most, size) if n >= folds else 1)
    base = F.when((F.col(ratio) > 0.8) & (F.col(length) > 20), 0.8).when(F.col(ratio) > 0.5, 0.6).otherwise(0.4)
    means = each.groupBy("fold").agg(F.avg(base).alias("base"))
    grid = F.explode(F.array(*(F.struct(F.lit(g["rank"]).alias("rank"), F.lit(g["rule_weight"]).alias("rule_weight"), F.lit(g["char_total"]).alias("char_total")) for g in weight_grid()))).alias("g")
    rows = means.select("base", grid).select("base", "g.*")
    score = F.col("base") * (F.least(F.col("rule_weight"), F.lit(0.5)) + F.least(F.col("char_total"), F.lit(0.5)))
    return rows.groupBy("rank", "rule_weight", "char_total").agg(F.avg(score).alias("cv_score"))


def integrated(rows: DataFrame, key: str, weights: dict[str, float], least: float = 0.5) -> DataFrame:
    """(key, position, score, n_sources, kind) of error rows (key, position, source, confidence).

    Confidences are averaged by source and place, then by the weights of the sources that are present; kind follows
    the strongest source: rule from 0.8, neural over 0.7, statistical over 0.7, else consensus.
    """
    mean = lambda s: F.avg(F.when(F.col("source") == s, F.col("confidence")))
    wide = rows.groupBy(key, "position").agg(*(mean(s).alias(s) for s in weights))
    total = sum((F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    score = sum((F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in weights.items()), F.lit(0.0)) / total
    kind = F.when(F.col("rule") >= 0.8, "rule").when(F.col("neural") > 0.7, "neural").when(F.col("statistical") > 0.7, "statistical").otherwise("consensus")
    n = sum((F.col(s).isNotNull().cast("bigint") for s in weights), F.lit(0).cast("bigint"))
    return wide.select(key, "position", score.alias("score"), n.alias("n_sources"), kind.alias("kind")).where(F.col("score") >= least)


def agreement(rows: DataFrame, key: str) -> DataFrame:
    """(key, agreement): the share of flagged places that two sources or more flag."""
    places = rows.groupBy(key, "position").agg(F.count_distinct("source").alias("n"))
    return places.groupBy(key).agg(F.avg(F.when(F.col("n") >= 2, 1.0).otherwise(0.0)).alias("agreement"))
