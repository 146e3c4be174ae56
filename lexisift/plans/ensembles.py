"""Queries of the ensemble of rules and six n-gram models, and of the hybrid validator's errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.scripts import SCRIPT
from lexisift.functions.segment import syllables
from lexisift.operators import ngrams as N
from lexisift.operators import rules as R
from lexisift.operators import voting as V
from lexisift.operators.neural import merged_errors
from lexisift.plans.combined import _BENCH_RULES, rule_ctes
from lexisift.plans.models import _ALL, _BENCH, _grams, _model, _padded, bench_texts, char_model, model_counts, one_of, syllable_model
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS
from lexisift.sources.shared import stored

MODELS = [("char" if kind == "char" else "syll", kind, n) for kind, n in _ALL]


def scored_ctes(kind: str, n: int, units: str | None = None) -> str:
    """CTEs up to scored (item_id, pos, ngram, p): the benchmark's n-grams by a model of the corpus."""
    sep = "" if kind == "char" else " | "
    return f"""{CORPUS}, {_model(kind, n)}, {_BENCH}, {_grams('h', units or _padded(kind, n, 'bench', 'item_id'), 'item_id', n, sep)},
scored AS (SELECT item_id, pos, h.ngram, CASE WHEN coalesce(ccnt, 0) > 0 THEN (coalesce(cnt, 0) + 1.0) / (ccnt + v) ELSE 1.0 / (total + v) END AS p FROM h LEFT JOIN ng USING (ngram) LEFT JOIN cx ON cx.context = h.context, sizes WHERE h.ngram IS NOT NULL)"""


def _score_sql(short: str, kind: str, n: int) -> str:
    low, size = "count(*) FILTER (WHERE p < 0.001)", "greatest(any_value(length(b.kt)), 1)"
    score = f"1 - {low} / {size}" if kind == "char" else f"coalesce(1 - {low} / nullif(count(p), 0), 0.0)"
    return f"SELECT item_id, model, score FROM (WITH {scored_ctes(kind, n)} SELECT b.item_id, '{short}{n}' AS model, {score} AS score FROM bench b LEFT JOIN scored USING (item_id) GROUP BY b.item_id)"


_RULE_SCORE = f"SELECT item_id, model, score FROM (WITH {_BENCH}, {_BENCH_RULES} SELECT b.item_id, 'rule' AS model, greatest(0.0, 1 - 2.0 * (SELECT count(*) FROM br WHERE br.item_id = b.item_id) / greatest(length(b.kt), 1)) AS score FROM bench b)"
_SCORES = f"{_BENCH}, ms AS ({' UNION ALL '.join([_RULE_SCORE, *(_score_sql(*m) for m in MODELS)])})"
_WEIGHT = "CASE model " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in V.DEFAULT_WEIGHTS.items()) + " END"


def scored(spark, sf_dir, kind: str, n: int, counts=None):
    texts = bench_texts(spark, sf_dir)
    if kind == "char":
        return N.scored(texts, "item_id", N.char_units("kt", n), one_of(counts, kind, n) if counts is not None else char_model(spark, sf_dir, n))
    return N.scored(texts, "item_id", N.syllable_units("kt", n), one_of(counts, kind, n) if counts is not None else syllable_model(spark, sf_dir, n))


def model_scores(spark, sf_dir, char3=None, counts=None):
    """(item_id, model, score) of the rules and the six n-gram models, written once.

    char3 and counts: the texts scored by the character model of three and the counts of all models, if a caller has them already.
    """
    texts = bench_texts(spark, sf_dir)
    counts = counts if counts is not None else model_counts(spark, sf_dir)
    out = R.rule_summary(texts, "item_id", "kt", None).select("item_id", F.lit("rule").alias("model"), F.col("rule_score").alias("score"))
    for short, kind, n in MODELS:
        own = char3 if char3 is not None and (kind, n) == ("char", 3) else scored(spark, sf_dir, kind, n, counts)
        each = own.groupBy("item_id").agg(F.count_if(F.col("probability") < 0.001).alias("low"), F.count("*").alias("n"))
        joined = texts.select("item_id", F.greatest(F.length("kt"), F.lit(1)).alias("size")).join(each, "item_id", "left")
        score = 1 - F.coalesce("low", F.lit(0)) / F.col("size") if kind == "char" else F.coalesce(1 - F.col("low") / F.col("n"), F.lit(0.0))
        out = out.unionByName(joined.select("item_id", F.lit(f"{short}{n}").alias("model"), score.alias("score")))
    return stored(out, "scores")


def weighted_scores(spark, sf_dir, char3=None, counts=None):
    weights = F.element_at(F.create_map(*(F.lit(x) for kw in V.DEFAULT_WEIGHTS.items() for x in kw)), F.col("model"))
    traits = bench_texts(spark, sf_dir).select("item_id", T.char_ratio("kt").alias("ratio"), F.length("kt").alias("size"))
    return model_scores(spark, sf_dir, char3, counts).withColumn("weight", weights).withColumn("confidence", V.confidences(F.col("model"))).join(traits, "item_id")


_TRAITS = f"SELECT item_id, model, score, {_WEIGHT}::DOUBLE AS weight, CASE WHEN model = 'rule' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, len(regexp_extract_all(kt, '[{SCRIPT}]')) / length(kt) AS ratio, length(kt) AS size FROM ms JOIN bench USING (item_id)"
_DYNAMIC = "weight * CASE WHEN model = 'rule' AND ratio > 0.8 THEN 1.2 WHEN model = 'rule' AND ratio < 0.5 THEN 0.7 WHEN size < 50 AND model IN ('char3', 'syll2') THEN 1.3 WHEN size > 200 AND model IN ('char5', 'syll4') THEN 1.2 ELSE 1.0 END"


@query(f"""WITH {_SCORES}, t AS ({_TRAITS}), d AS (SELECT *, {_DYNAMIC} AS dw FROM t)
SELECT item_id, round(sum(score * weight) / sum(weight), 6) AS weighted, round(sum(score * weight * confidence) / sum(weight * confidence), 6) AS by_confidence, round(sum(score * dw * confidence) / sum(dw * confidence), 6) AS dynamic, round(sum(score * weight) / sum(weight), 6) AS majority FROM d GROUP BY item_id""")
def ensemble_votes(spark, sf_dir):
    """The votes of all seven models by each method; the majority falls to the weighted vote."""
    rows = weighted_scores(spark, sf_dir)
    one = lambda method, name: V.vote(rows, "item_id", method, "ratio", "size").select("item_id", F.round("vote", 6).alias(name))
    return reduce(lambda a, b: a.join(b, "item_id"), (one(*x) for x in (("weighted", "weighted"), ("confidence_weighted", "by_confidence"), ("dynamic", "dynamic"), ("majority", "majority"))))


_SUMMARY = "SELECT item_id, max(score) FILTER (WHERE model = 'rule') AS rule_score, avg(score) FILTER (WHERE model <> 'rule') AS statistical_score, greatest(0.0, 1 - 4 * var_pop(score)) AS consensus_score FROM ms GROUP BY item_id"


@query(f"WITH {_SCORES}, s AS ({_SUMMARY}) SELECT item_id, round(rule_score, 6) AS rule_score, round(statistical_score, 6) AS statistical_score, round(consensus_score, 6) AS consensus_score FROM s")
def ensemble_scores(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return V.score_summary(model_scores(spark, sf_dir), "item_id").select("item_id", r("rule_score"), r("statistical_score"), r("consensus_score"))


def _error_sql(order: int, short: str, kind: str, n: int, source: str) -> str:
    """Rows (item_id, position, segment, type, confidence, o, pos) of a model's errors."""
    row = f"'{source}' AS type, 1 - p / 0.001 AS confidence, {order} AS o, s.pos::BIGINT AS pos"
    if kind == "char":
        return f"SELECT * FROM (WITH {scored_ctes(kind, n)} SELECT item_id, greatest(0, pos - {n - 1})::BIGINT AS position, ngram AS segment, {row} FROM scored s WHERE p < 0.001)"
    return f"""SELECT * FROM (WITH {scored_ctes(kind, n)}, st AS (SELECT item_id, t AS syllable, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS at, sum(length(t)) OVER (PARTITION BY item_id ORDER BY pos) - length(t) AS start, count(*) OVER (PARTITION BY item_id) AS n FROM h_e WHERE t NOT IN ('<START>', '<END>'))
SELECT s.item_id, st.start::BIGINT AS position, st.syllable AS segment, {row} FROM scored s JOIN st ON st.item_id = s.item_id AND st.at = least(s.pos + {n - 1}, st.n - 1) WHERE p < 0.001)"""


def _rule_error_sql(whole: bool) -> str:
    ctes = rule_ctes("bench", "item_id") if whole else f"{_BENCH_RULES}, rule_rows AS (SELECT item_id, position::BIGINT AS position, 2::BIGINT AS length, CASE WHEN substr(kt, position::BIGINT + 1, 2) = chr(6098) || chr(6098) THEN 'invalid_unicode_sequence' ELSE 'invalid_character_sequence' END AS type, 'error' AS severity FROM br JOIN bench USING (item_id))"
    return f"SELECT * FROM (WITH {_BENCH}, {ctes} SELECT r.item_id, position, substr(kt, position::BIGINT + 1, r.length::BIGINT) AS segment, {chr(39) + 'rule' + chr(39) if whole else 'type'} AS type, 0.9::DOUBLE AS confidence, 0 AS o, position AS pos FROM rule_rows r JOIN bench b USING (item_id) WHERE severity = 'error')"


def rule_errors(spark, sf_dir, whole: bool):
    """Rows (item_id, position, segment, type, confidence, source, ord) of rule errors; their own texts give the segments."""
    d = R.with_errors(bench_texts(spark, sf_dir), "kt", syllables("kt") if whole else None).select("item_id", "kt", F.explode("rule_errors").alias("e")).where("e.severity = 'error'")
    position = F.col("e.position").cast("bigint")
    return d.select("item_id", position.alias("position"), F.expr("substr(kt, e.position + 1, e.length)").alias("segment"), F.col("e.type").alias("type"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("source"), F.struct(F.lit(0).alias("o"), position.alias("pos")).alias("ord"))


def model_errors(spark, sf_dir, kind: str, n: int, source: str, order: int):
    texts, each = bench_texts(spark, sf_dir), scored(spark, sf_dir, kind, n)
    if kind == "char":
        found = N.char_errors(each, texts, "item_id", "kt", n).withColumnRenamed("ngram", "segment")
    else:
        empty = spark.createDataFrame([], "token string")
        found = N.syllable_errors(texts, "item_id", "kt", each, empty, n).withColumnRenamed("syllable", "segment")
    pos = F.col("pos").cast("bigint")
    return found.select("item_id", F.col("start").cast("bigint").alias("position"), "segment", F.lit(source).alias("type"), "confidence", F.lit(source).alias("source"), F.struct(F.lit(order).alias("o"), pos.alias("pos")).alias("ord"))


_HYBRID_ERRORS = " UNION ALL ".join([_rule_error_sql(True), _error_sql(1, "char", "char", 3, "character"), _error_sql(2, "syll", "syllable", 2, "syllable")])


def combined_errors(spark, sf_dir):
    rows = rule_errors(spark, sf_dir, True).unionByName(model_errors(spark, sf_dir, "char", 3, "character", 1)).unionByName(model_errors(spark, sf_dir, "syllable", 2, "syllable", 2))
    return V.best_errors(rows, "item_id")


@query(f"WITH e AS ({_HYBRID_ERRORS}), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, position, segment ORDER BY confidence DESC, o, pos) AS rn FROM e) SELECT item_id, position, segment, type AS source, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY item_id ORDER BY position, o, pos) AS place FROM r WHERE rn = 1")
def hybrid_errors(spark, sf_dir):
    """The errors of rules, characters and syllables, the most confident of each place and segment, in order of place."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("item_id").orderBy("position", "ord")).cast("bigint")
    return combined_errors(spark, sf_dir).select("item_id", "position", "segment", "source", F.round("confidence", 6).alias("confidence"), place.alias("place"))


_REPORT = f"""e AS ({_HYBRID_ERRORS}), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, position, segment ORDER BY confidence DESC, o, pos) AS rn FROM e), x AS (SELECT type AS source FROM r WHERE rn = 1)"""


@query(f"WITH {_REPORT} SELECT 'source' AS kind, source AS name, row_number() OVER (ORDER BY count(*) DESC, source) AS rank, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM x GROUP BY source")
def hybrid_report(spark, sf_dir):
    """The errors of a batch by source, most first."""
    return V.error_report(combined_errors(spark, sf_dir), "source").withColumn("percent", F.round("percent", 6))


_ALL_ERRORS = " UNION ALL ".join([_rule_error_sql(False), *(_error_sql(k, s, kind, n, f"{'character' if kind == 'char' else 'syllable'}_{n}gram") for k, (s, kind, n) in enumerate(MODELS, 1))])


@query(f"""WITH e AS ({_ALL_ERRORS}), l AS (SELECT item_id, position, segment, list({{'type': type, 'confidence': confidence}} ORDER BY o, pos) AS es FROM e GROUP BY ALL),
f AS (SELECT item_id, position, segment, list_reduce(es, lambda a, b: CASE WHEN b.confidence > 1.1 * a.confidence THEN b WHEN abs(b.confidence - a.confidence) < 0.1 THEN {{'type': a.type, 'confidence': greatest(a.confidence, b.confidence)}} ELSE a END) AS x FROM l)
SELECT item_id, position, segment, x.type AS type, round(x.confidence, 6) AS confidence FROM f""")
def ensemble_errors(spark, sf_dir):
    """The errors of all seven models, merged place by place."""
    rows = rule_errors(spark, sf_dir, False)
    for k, (_, kind, n) in enumerate(MODELS, 1):
        rows = rows.unionByName(model_errors(spark, sf_dir, kind, n, f"{'character' if kind == 'char' else 'syllable'}_{n}gram", k))
    out = merged_errors(rows.withColumn("description", F.col("type")), "item_id")
    return out.select("item_id", "position", "segment", "type", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_SCORES}, t AS ({_TRAITS}), s AS ({_SUMMARY}), v AS (SELECT item_id, sum(score * weight) / sum(weight) AS vote, sum(score * weight * confidence) / sum(score * weight) AS confidence FROM t GROUP BY item_id),
a AS (SELECT count(*) FILTER (WHERE vote > 0.7) / count(*) AS accuracy, avg(consensus_score) AS c, avg(confidence) AS f FROM v JOIN s USING (item_id))
SELECT round(accuracy, 6) AS accuracy, round(accuracy * 0.9, 6) AS "precision", round(accuracy * 0.85, 6) AS recall, round(accuracy * 0.87, 6) AS f1_score, round(accuracy * 0.9, 6) AS rule_based_accuracy, round(accuracy * 0.8, 6) AS character_ngram_accuracy, round(accuracy * 0.85, 6) AS syllable_ngram_accuracy,
round(c, 6) AS consensus_rate, round(f, 6) AS confidence_correlation, round(c * f, 6) AS voting_efficiency, 0.1::DOUBLE AS false_positive_rate, 0.15::DOUBLE AS false_negative_rate FROM a""")
def ensemble_metrics(spark, sf_dir):
    rows = weighted_scores(spark, sf_dir)
    votes = V.weighted_vote(rows, "item_id").join(V.score_summary(rows, "item_id"), "item_id")
    out = V.ensemble_metrics(votes.select((F.col("vote") > 0.7).alias("is_valid"), "consensus_score", F.col("vote_confidence").alias("confidence_score")))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(" UNION ALL ".join(f"SELECT item_id, {n} AS n, n_ngrams, n_errors, round(1 - n_errors / n_ngrams, 6) AS overall_score FROM (WITH {scored_ctes('char', n)} SELECT item_id, count(*) AS n_ngrams, count(*) FILTER (WHERE p < 0.001) AS n_errors FROM scored GROUP BY item_id)" for n in (3, 4, 5)))
def char_error_sizes(spark, sf_dir):
    """Error detection by the character models of all sizes."""
    parts = [N.error_summary(scored(spark, sf_dir, "char", n), "item_id").select("item_id", F.lit(n).alias("n"), "n_ngrams", "n_errors", F.round("overall_score", 6).alias("overall_score")) for n in (3, 4, 5)]
    return reduce(lambda a, b: a.unionByName(b), parts)
