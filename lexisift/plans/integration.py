"""Queries of the integrator and of fused validation, with n-gram models as the neural scorer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexisift.functions.segment import syllables
from lexisift.operators import integrator as I
from lexisift.operators import neural as M
from lexisift.operators import search as P
from lexisift.operators import vocab as U
from lexisift.operators import voting as V
from lexisift.plans.combined import _BENCH_RULES
from lexisift.plans.ensembles import _SCORES, _TRAITS, scored_ctes, weighted_scores
from lexisift.plans.models import _BENCH, bench_texts, char_model, char_scored, model_counts, one_of, syllable_model
from lexisift.plans.registry import query
from lexisift.plans.sqltext import tokens
from lexisift.plans.vocabularies import _PERP
from lexisift.sources.shared import stored

SETTINGS = I.Settings()
_UNITS = f"SELECT item_id, {tokens()} AS a FROM bench"
_PAIRS = f"(WITH {scored_ctes('syllable', 2, _UNITS)} SELECT item_id, pos::BIGINT AS position, p FROM scored)"
_FLAGGED = " UNION ALL ".join(f"SELECT * FROM (WITH {scored_ctes('syllable', n, _UNITS)} SELECT item_id, pos::BIGINT AS position, p FROM scored WHERE p < 0.01)" for n in (2, 3, 4))
#: Errors of the three sources by item and place (errs), and their scores (scores).
_SOURCES = f"""{_BENCH}, pairs AS (SELECT * FROM {_PAIRS}), flagged AS ({_FLAGGED}), rules AS (SELECT * FROM (WITH {_BENCH}, {_BENCH_RULES} SELECT item_id, position::BIGINT AS position FROM br)),
errs AS (SELECT item_id, position, 'neural' AS source, 1 - p AS confidence FROM pairs WHERE p < 0.1 UNION ALL SELECT item_id, position, 'statistical', avg(1 - p / 0.01) FROM flagged GROUP BY ALL UNION ALL SELECT item_id, position, 'rule', 0.9 FROM rules),
scores AS (SELECT b.item_id, coalesce((SELECT least(max(p), 1.0) FROM pairs x WHERE x.item_id = b.item_id), 0.0) AS neural, coalesce((SELECT avg(p) FROM flagged x WHERE x.item_id = b.item_id), 1.0) AS statistical, greatest(0.0, 1 - 2.0 * (SELECT count(*) FROM rules x WHERE x.item_id = b.item_id) / greatest(length(b.kt), 1)) AS rule FROM bench b),
wide AS (SELECT item_id, position, avg(confidence) FILTER (WHERE source = 'rule') AS rule, avg(confidence) FILTER (WHERE source = 'statistical') AS st, avg(confidence) FILTER (WHERE source = 'neural') AS nn FROM errs GROUP BY ALL),
merged AS (SELECT item_id, position, (coalesce(nn * 0.35, 0) + coalesce(st * 0.45, 0) + coalesce(rule * 0.2, 0)) / (CASE WHEN nn IS NULL THEN 0 ELSE 0.35 END + CASE WHEN st IS NULL THEN 0 ELSE 0.45 END + CASE WHEN rule IS NULL THEN 0 ELSE 0.2 END) AS score, ((rule IS NOT NULL)::INTEGER + (st IS NOT NULL)::INTEGER + (nn IS NOT NULL)::INTEGER)::BIGINT AS n_sources,
CASE WHEN rule >= 0.8 THEN 'rule' WHEN nn > 0.7 THEN 'neural' WHEN st > 0.7 THEN 'statistical' ELSE 'consensus' END AS kind FROM wide),
agreed AS (SELECT item_id, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS agreement FROM (SELECT item_id, position, count(DISTINCT source) AS n FROM errs GROUP BY ALL) GROUP BY item_id),
results AS (SELECT s.item_id, s.neural, s.statistical, s.rule, coalesce(agreement, 1.0) AS agreement, coalesce(n, 0) AS n_errors, (s.neural * 0.35 + s.statistical * 0.45 + s.rule * 0.2) * (0.5 + 0.5 * coalesce(agreement, 1.0)) AS confidence FROM scores s LEFT JOIN agreed USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM merged WHERE score >= 0.5 GROUP BY item_id) m USING (item_id))"""


def sources(spark, sf_dir):
    """Errors and scores of the neural source, the three syllable models and the rules."""
    texts = bench_texts(spark, sf_dir)
    models = [syllable_model(spark, sf_dir, n) for n in (2, 3, 4)]
    found = {
        "neural": I.neural_source(texts, "item_id", syllables("kt"), models[0], SETTINGS),
        "statistical": I.statistical_source(texts, "item_id", syllables("kt"), models, SETTINGS),
        "rule": I.rule_source(texts, "item_id", "kt"),
    }
    return I.error_rows({k: e for k, (e, _) in found.items()}, "item_id"), {k: s for k, (_, s) in found.items()}


def results(spark, sf_dir):
    errors, scores = sources(spark, sf_dir)
    return I.results(bench_texts(spark, sf_dir), "item_id", scores, errors, SETTINGS)


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@query(f"WITH {_SOURCES} SELECT item_id, position, source, round(confidence, 6) AS confidence FROM errs")
def source_errors(spark, sf_dir):
    return _rounded(sources(spark, sf_dir)[0], "confidence")


@query(f"WITH {_SOURCES} SELECT item_id, position, round(score, 6) AS score, n_sources, kind FROM merged WHERE score >= 0.5")
def integrated_errors(spark, sf_dir):
    return _rounded(V.integrated(sources(spark, sf_dir)[0], "item_id", SETTINGS.weights()), "score")


@query(f"WITH {_SOURCES} SELECT item_id, round(agreement, 6) AS agreement FROM agreed")
def method_agreement(spark, sf_dir):
    return _rounded(V.agreement(sources(spark, sf_dir)[0], "item_id"), "agreement")


@query(f"WITH {_SOURCES} SELECT item_id, round(neural, 6) AS neural, round(statistical, 6) AS statistical, round(rule, 6) AS rule, round(agreement, 6) AS agreement, n_errors, round(confidence, 6) AS confidence, n_errors = 0 AND confidence >= 0.65 AS is_valid FROM results")
def integrated_results(spark, sf_dir):
    """The final verdict on each benchmark text."""
    return _rounded(results(spark, sf_dir), "neural", "statistical", "rule", "agreement", "confidence")


@query(f"WITH {_SOURCES} SELECT count(*) AS texts, sum(n_errors)::BIGINT AS errors, round(count(*) / greatest(sum(n_errors), 1), 6) AS texts_per_error, round(count(*) FILTER (WHERE n_errors = 0 AND confidence >= 0.65) / count(*), 6) AS validation_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(agreement), 6) AS mean_agreement FROM results")
def integration_statistics(spark, sf_dir):
    return _rounded(I.statistics(results(spark, sf_dir)), "texts_per_error", "validation_rate", "mean_confidence", "mean_agreement")


@query(f"WITH {_SOURCES}, m AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_errors = 0 AND confidence >= 0.65) / count(*) AS a, avg(confidence) AS c, avg(agreement) AS g, least(1.0, sum(n_errors) / greatest(1.0, 0.1 * count(*))) AS d FROM results) SELECT round(a, 6) AS accuracy, round(c, 6) AS confidence, round(g, 6) AS agreement, 0.0::DOUBLE AS speed, round(d, 6) AS detection, round(greatest(0.0, least(1.0, 0.4 * a + 0.2 * c + 0.2 * g + 0.1 * d)), 6) AS objective FROM m")
def objective_scores(spark, sf_dir):
    """The objective of the default configuration over the benchmark; no time is measured, so speed counts as 0."""
    return _rounded(I.metrics(results(spark, sf_dir)).withColumn("objective", P.objective()), "accuracy", "confidence", "agreement", "speed", "detection", "objective")


_GRID = ", ".join(f"(SELECT unnest([{', '.join(str(low + (high - low) * i / 2) for i in range(3))}])::DOUBLE AS {k})" for k, (low, high) in P.SPACE.items())


@query(f"""WITH {_SOURCES}, g AS (SELECT neural_weight / t AS nw, statistical_weight / t AS sw, rule_weight / t AS rw, et, ct FROM (SELECT *, neural_weight + statistical_weight + rule_weight AS t, error_threshold AS et, consensus_threshold AS ct FROM {_GRID})),
folds AS (SELECT item_id, least((row_number() OVER (ORDER BY item_id) - 1) // (count(*) OVER () // 5), 4) AS fold FROM bench),
e AS (SELECT nw, sw, rw, et, ct, item_id, count(*) FILTER (WHERE position IS NOT NULL AND (coalesce(nn * nw, 0) + coalesce(st * sw, 0) + coalesce(w.rule * rw, 0)) / (CASE WHEN nn IS NULL THEN 0 ELSE nw END + CASE WHEN st IS NULL THEN 0 ELSE sw END + CASE WHEN w.rule IS NULL THEN 0 ELSE rw END) >= et - 1e-9) AS n FROM g, results LEFT JOIN wide w USING (item_id) GROUP BY ALL),
c AS (SELECT e.*, fold, agreement, (neural * nw + statistical * sw + rule * rw) * (0.5 + 0.5 * agreement) AS confidence FROM e JOIN results USING (item_id) JOIN folds USING (item_id)),
m AS (SELECT nw, sw, rw, et, ct, fold, count(*) FILTER (WHERE n = 0 AND confidence >= ct) / count(*) AS a, avg(confidence) AS c, avg(agreement) AS ag, least(1.0, sum(n) / greatest(1.0, 0.1 * count(*))) AS d FROM c GROUP BY ALL)
SELECT round(nw, 6) AS neural_weight, round(sw, 6) AS statistical_weight, round(rw, 6) AS rule_weight, round(et, 6) AS error_threshold, round(ct, 6) AS consensus_threshold, round(avg(0.4 * a + 0.2 * c + 0.2 * ag + 0.1 * d), 5) AS mean_score, round(stddev_pop(0.4 * a + 0.2 * c + 0.2 * ag + 0.1 * d), 5) AS deviation FROM m GROUP BY nw, sw, rw, et, ct""")
def param_scores(spark, sf_dir):
    """The objective of each parameter set of a grid over five contiguous folds of the benchmark."""
    errors, scores = sources(spark, sf_dir)
    texts = I.results(bench_texts(spark, sf_dir), "item_id", scores, errors, SETTINGS)
    out = P.cross_validated(P.grid(spark, 3), P.contiguous_folds(texts, "item_id", 5), errors, "item_id")
    weights = [F.round(k, 6).alias(k) for k in P.SPACE]
    return out.select(*weights, F.round("mean_score", 5).alias("mean_score"), F.round("deviation", 5).alias("deviation"))


_VALID = "nv AS (SELECT item_id, p AS perplexity, coalesce(n_anomalies, 0) AS n_anomalies, 1 / (1 + p / 10) AS confidence FROM (SELECT item_id, exp(avg(ln(x))) AS p FROM pp GROUP BY item_id) LEFT JOIN (SELECT item_id, count(*) AS n_anomalies FROM pp JOIN (SELECT item_id, count(*) AS n, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS u FROM pp GROUP BY item_id) q USING (item_id) WHERE n >= 3 AND x > m + 2 * (u - m) GROUP BY item_id) USING (item_id))"
_NEURAL = f"neural AS (SELECT * FROM (WITH {_PERP}, {_VALID} SELECT item_id, perplexity, confidence, perplexity < 50 AND n_anomalies = 0 AS valid FROM nv))"
_STAT = f"stat AS (SELECT * FROM (WITH {_SCORES}, t AS ({_TRAITS}) SELECT item_id, sum(score * weight) / sum(weight) AS confidence FROM t GROUP BY item_id))"


def char3_scores(spark, sf_dir, counts):
    """The texts scored by the character model of three, written once: both sources read them."""
    return stored(char_scored(spark, sf_dir, one_of(counts, "char", 3)), "char3")


def neural_verdicts(scored):
    each = U.perplexities(scored, "item_id")
    return M.validated(U.sequence_perplexity(each, "item_id"), U.anomalies(each, "item_id"), "item_id")


def statistical_verdicts(spark, sf_dir, scored, counts):
    vote = V.weighted_vote(weighted_scores(spark, sf_dir, scored, counts), "item_id")
    return vote.select("item_id", F.col("vote").alias("confidence"), (F.col("vote") > 0.7).alias("valid"))


@query(f"WITH {_PERP}, {_VALID} SELECT item_id, round(perplexity, 5) AS perplexity, n_anomalies, round(confidence, 6) AS confidence, perplexity < 50 AND n_anomalies = 0 AS neural_valid FROM nv")
def neural_validation(spark, sf_dir):
    out = neural_verdicts(char_scored(spark, sf_dir))
    return out.withColumn("perplexity", F.round("perplexity", 5)).withColumn("confidence", F.round("confidence", 6))


_FUSED = """CASE strategy WHEN 'confidence_based' THEN CASE WHEN n + s > 0 THEN (n * n + s * s) / (n + s) ELSE 0 END WHEN 'majority_vote' THEN CASE WHEN n >= 0.6 AND s >= 0.7 THEN (n + s) / 2 WHEN n >= 0.6 THEN n WHEN s >= 0.7 THEN s ELSE least(n, s) END ELSE 0.3 * n + 0.7 * s END"""
_HYBRID = f"""{_NEURAL}, {_STAT}, j AS (SELECT item_id, neural.confidence AS n, stat.confidence AS s, perplexity, valid AS nv, stat.confidence > 0.7 AS sv, strategy FROM stat JOIN neural USING (item_id), (SELECT unnest(['weighted_average', 'confidence_based', 'majority_vote']) AS strategy)),
f AS (SELECT *, {_FUSED} AS combined FROM j), h AS (SELECT *, combined >= 0.65 AND perplexity <= 100 AND CASE strategy WHEN 'majority_vote' THEN (nv AND n >= 0.6) OR (sv AND s >= 0.7) WHEN 'confidence_based' THEN CASE WHEN n >= 0.6 AND s >= 0.7 THEN nv AND sv ELSE (nv AND n >= 0.6) OR (sv AND s >= 0.7) END ELSE true END AS ok FROM f)"""


def hybrids(spark, sf_dir):
    counts = model_counts(spark, sf_dir)
    scored = char3_scores(spark, sf_dir, counts)
    n, s = neural_verdicts(scored), statistical_verdicts(spark, sf_dir, scored, counts)
    return reduce(lambda a, b: a.unionByName(b), (M.hybrid(n, s, "item_id", k).withColumn("strategy", F.lit(k)) for k in M.STRATEGIES))


@query(f"WITH {_HYBRID} SELECT item_id, strategy, round(n, 6) AS neural_confidence, round(s, 6) AS statistical_confidence, round(combined, 6) AS combined, ok AS is_valid, 'hybrid' AS method FROM h")
def fused_scores(spark, sf_dir):
    """Confidences of both sources fused by each strategy, and the verdict that follows."""
    return _rounded(hybrids(spark, sf_dir), "neural_confidence", "statistical_confidence", "combined")


@query(f"WITH {_HYBRID} SELECT strategy, count(*) AS texts, count(*) FILTER (WHERE ok) AS valid_texts, round(count(*) FILTER (WHERE ok) / count(*), 6) AS validation_rate, round(coalesce(avg(n) FILTER (WHERE n > 0), 0), 6) AS mean_neural_confidence, round(coalesce(avg(s) FILTER (WHERE s > 0), 0), 6) AS mean_statistical_confidence, round(avg(combined), 6) AS mean_combined FROM h GROUP BY strategy")
def hybrid_performance(spark, sf_dir):
    return _rounded(M.performance(hybrids(spark, sf_dir), "strategy"), "validation_rate", "mean_neural_confidence", "mean_statistical_confidence", "mean_combined")


@query(f"WITH {_NEURAL}, {_STAT} SELECT round(w, 1) AS weight, round(avg(w * neural.confidence + (1 - w) * stat.confidence), 6) AS mean_score FROM stat JOIN neural USING (item_id), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS w) GROUP BY w")
def fusion_sweep(spark, sf_dir):
    counts = model_counts(spark, sf_dir)
    scored = char3_scores(spark, sf_dir, counts)
    both = neural_verdicts(scored).select("item_id", F.col("confidence").alias("neural")).join(statistical_verdicts(spark, sf_dir, scored, counts).select("item_id", F.col("confidence").alias("statistical")), "item_id")
    return M.weight_sweep(both, "item_id").withColumn("mean_score", F.round("mean_score", 6))


@query(f"""WITH {_SOURCES}, a AS (SELECT item_id, position, source, confidence FROM errs WHERE source IN ('neural', 'statistical')), both_ AS (SELECT item_id, position FROM a GROUP BY ALL HAVING count(DISTINCT source) = 2)
SELECT 'union' AS strategy, item_id, position, source, round(confidence, 6) AS confidence FROM a UNION ALL SELECT 'intersection', item_id, position, source, round(confidence, 6) FROM a SEMI JOIN both_ USING (item_id, position)
UNION ALL SELECT 'confidence_weighted', item_id, position, source, round(confidence, 6) FROM a WHERE confidence >= CASE WHEN source = 'neural' THEN 0.6 ELSE 0.7 END""")
def fused_errors(spark, sf_dir):
    """Errors of the neural and the statistical source, fused by each strategy."""
    e = sources(spark, sf_dir)[0]
    a, b = e.where("source = 'neural'"), e.where("source = 'statistical'")
    parts = [M.fused_errors(a, b, "item_id", s).select(F.lit(s).alias("strategy"), "item_id", "position", "source", "confidence") for s in ("union", "intersection", "confidence_weighted")]
    return _rounded(reduce(lambda x, y: x.unionByName(y), parts), "confidence")


_CHAR3 = scored_ctes("char", 3)


@query(f"""WITH {_CHAR3}, w AS (SELECT item_id, pos, kt, substr(kt, pos - 1, 2) AS context, substr(kt, pos + 1, 1) AS own FROM scored JOIN bench USING (item_id) WHERE p < 0.001 AND pos >= 5 AND pos < length(kt)),
r AS (SELECT context, right(ngram, 1) AS unit, cnt / ccnt AS probability, row_number() OVER (PARTITION BY context ORDER BY cnt / ccnt DESC, right(ngram, 1)) AS place FROM ng JOIN cx USING (context) WHERE cnt / ccnt >= 0.1 AND right(ngram, 1) <> '<'),
f AS (SELECT item_id, pos::BIGINT AS position, unit, probability, row_number() OVER (PARTITION BY item_id, pos ORDER BY place) AS rank FROM w JOIN r USING (context) WHERE place <= 20 AND unit <> own)
SELECT item_id, position, rank, unit AS suggestion, round(probability, 6) AS probability FROM f WHERE rank <= 3""")
def corrections(spark, sf_dir):
    """What the character model would rather have at each improbable place."""
    bad = char_scored(spark, sf_dir).where(F.col("probability") < 0.001).select("item_id", F.col("pos").cast("bigint").alias("position"))
    out = M.corrections(bad, bench_texts(spark, sf_dir), "item_id", "kt", char_model(spark, sf_dir))
    return _rounded(out, "probability")


@query(f"""WITH {_CHAR3}, r AS (SELECT context, right(ngram, 1) AS unit, pow(cnt, 1 / 0.8) AS share, row_number() OVER (PARTITION BY context ORDER BY cnt DESC, right(ngram, 1)) AS rank FROM ng)
SELECT context, rank::INTEGER AS rank, unit, round(share / sum(share) OVER (PARTITION BY context), 6) AS probability FROM r WHERE rank <= 5""")
def next_chars(spark, sf_dir):
    """The five likeliest characters after each context, at a temperature of 0.8."""
    return _rounded(M.next_units(char_model(spark, sf_dir), 5, 0.8), "probability")


@query(f"""WITH {_CHAR3}, s AS (SELECT item_id, pos, 1 / greatest(p, 1e-10) AS x FROM scored JOIN bench USING (item_id) WHERE pos < length(kt) AND length(kt) > 1)
SELECT item_id, pos::INTEGER AS pos, round(x, 5) AS perplexity FROM s WHERE pos > 0 UNION ALL SELECT item_id, 0, round(x, 5) FROM s WHERE pos = 1 UNION ALL SELECT item_id, 0, 1.0 FROM bench WHERE length(kt) = 1""")
def char_perplexities(spark, sf_dir):
    out = M.char_perplexities(char_scored(spark, sf_dir), bench_texts(spark, sf_dir), "item_id", "kt")
    return out.withColumn("perplexity", F.round("perplexity", 5))


@query(f"""WITH {_PERP}, q AS (SELECT item_id, count(*) AS n, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS u FROM pp GROUP BY item_id), a AS (SELECT item_id, pos, x FROM pp JOIN q USING (item_id) WHERE n >= 3 AND x > m + 2 * (u - m))
SELECT item_id, count(a.pos) AS n_errors, round(coalesce(avg(a.x), 0.0), 5) AS mean_perplexity, coalesce(string_agg(a.pos::VARCHAR, ',' ORDER BY a.pos), '') AS positions FROM q LEFT JOIN a USING (item_id) GROUP BY item_id""")
def anomaly_summary(spark, sf_dir):
    each = U.perplexities(char_scored(spark, sf_dir), "item_id")
    out = M.anomaly_summary(U.anomalies(each, "item_id"), each, "item_id")
    return out.select("item_id", "n_errors", F.round("mean_perplexity", 5).alias("mean_perplexity"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))
