"""What the service answers, as functions of tables: validation, health and metrics. There is no server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.segment import segment, syllables
from lexisift.operators import integrator as I
from lexisift.operators import ngrams as N
from lexisift.operators import voting as V

COMPONENTS = ("segmenter", "neural", "statistical", "rules")


def validate(df: DataFrame, key: str, text: str, models: list[N.Model], settings: I.Settings = I.Settings()) -> DataFrame:
    """(key, success, syllable_count, is_valid, confidence, n_errors, errors) of each text; texts that cannot be segmented are invalid.

    models: syllable models by rising size, the first one of pairs. errors are the integrated ones in order of place.
    """
    texts = segment(df.select(key, F.col(text).alias("text"))).select(key, "text", "syllable_count", "success")
    sources = {"neural": I.neural_source(texts, key, syllables("text"), models[0], settings), "statistical": I.statistical_source(texts, key, syllables("text"), models, settings), "rule": I.rule_source(texts, key, "text")}
    errors = I.error_rows({k: e for k, (e, _) in sources.items()}, key)
    found = I.results(texts, key, {k: s for k, (_, s) in sources.items()}, errors, settings)
    listed = V.integrated(errors, key, settings.weights(), settings.error_confidence_threshold).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "kind", "score"))).alias("errors"))
    out = texts.join(found.select(key, "is_valid", "confidence", "n_errors"), key).join(listed, key, "left")
    none = F.array().cast("array<struct<position:bigint,kind:string,score:double>>")
    return out.select(key, "success", "syllable_count", (F.col("success") & F.col("is_valid")).alias("is_valid"), F.when(F.col("success"), F.col("confidence")).otherwise(0.0).alias("confidence"), "n_errors", F.coalesce("errors", none).alias("errors"))


def health(loaded: dict[str, bool]) -> dict:
    """healthy if all four components are loaded, else degraded."""
    state = {k: bool(loaded.get(k)) for k in COMPONENTS}
    return {"status": "healthy" if all(state.values()) else "degraded", "models_loaded": state}


def metrics(log: DataFrame, time: str, seconds: str, request: list[str], failed: Column) -> DataFrame:
    """One row over a request log: requests, errors, mean seconds, throughput over the time it spans, cache hits and error rate.

    A request that an equal one (by the columns ``request``) came before is one that a cache would have answered.
    """
    n = F.count("*")
    span = F.greatest(F.unix_timestamp(F.max(time)) - F.unix_timestamp(F.min(time)), F.lit(1))
    totals = log.agg(n.alias("requests"), F.count_if(failed).alias("errors"), F.avg(seconds).alias("mean_seconds"), (n / span).alias("throughput"), (F.count_if(failed) / n).alias("error_rate"))
    distinct = log.groupBy(*request).count().agg(F.count("*").alias("distinct"))
    return totals.crossJoin(F.broadcast(distinct)).withColumn("cache_hit_rate", 1 - F.col("distinct") / F.col("requests")).drop("distinct")  # one row is broadcast


def rating(latency_ms: Column, throughput: Column, error_rate: Column) -> Column:
    """struct(latency, throughput, errors, overall): words for latency, texts a second and the share of errors, and what they come to."""

    def by(good: list[Column], worst: str) -> Column:
        out = F.lit(worst)
        for name, ok in reversed(list(zip(("Excellent", "Good", "Acceptable"), good))):
            out = F.when(ok, name).otherwise(out)
        return out

    # The limits.
    each = [by([latency_ms < x for x in (10, 50, 100)], "Needs improvement"), by([throughput > x for x in (1000, 500, 100)], "Needs improvement"), by([error_rate < x for x in (0.1, 0.3, 0.5)], "High")]
    within = lambda *names: each[0].isin(*names) & each[1].isin(*names) & each[2].isin(*names)
    overall = F.when(within("Excellent"), "Production Ready - Excellent").when(within("Excellent", "Good"), "Production Ready - Good").when(within("Excellent", "Good", "Acceptable"), "Production Ready - Acceptable").otherwise("Needs Optimization")
    return F.struct(*(x.alias(k) for k, x in zip(("latency", "throughput", "errors"), each)), overall.alias("overall"))
