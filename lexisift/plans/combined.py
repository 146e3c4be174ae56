"""Queries of rules, hybrid validation and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.scripts import RULE_CONSONANT, RULE_DEPENDENT, RULE_MARK, RULE_VOWEL, SCRIPT, SPACE_RE2
from lexisift.functions.segment import syllables
from lexisift.operators import rules as R
from lexisift.operators import voting as V
from lexisift.plans.models import bench_texts, char_scored, syllable_scored, _SCORED, _SYLL_SCORED, _model
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, not_blank, tokens
from lexisift.sources.corpus import projected

_WHOLE = R.WHOLE


def rule_ctes(source: str, key: str) -> str:
    """CTEs up to rule_rows (key, position, length, type, severity): the error rows of the texts kt of ``source``."""
    return f"""sy AS (SELECT {key}, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM (SELECT {key}, {tokens()} AS s FROM {source})), pl AS (SELECT *, (sum(length(x)) OVER (PARTITION BY {key} ORDER BY k) - length(x))::BIGINT AS off FROM sy),
odd AS (SELECT * FROM pl WHERE {not_blank('x')} AND NOT regexp_matches(x, '{_WHOLE}') AND regexp_matches(x, '[{RULE_MARK}{RULE_DEPENDENT}]')),
ch AS (SELECT {key}, k, off, x, unnest(string_split(x, '')) AS c, generate_subscripts(string_split(x, ''), 1) - 1 AS i FROM odd),
nb AS (SELECT *, lead(c) OVER w AS nx, lag(c) OVER w AS pv FROM ch WINDOW w AS (PARTITION BY {key}, k ORDER BY i)),
dc AS (SELECT {key}, unnest(regexp_extract_all(kt, '(?s).')) AS c, generate_subscripts(regexp_extract_all(kt, '(?s).'), 1) - 1 AS i FROM {source}),
ad AS (SELECT {key}, i, c, lead(c) OVER (PARTITION BY {key} ORDER BY i) AS nx FROM dc),
rule_rows AS (SELECT {key}, off::BIGINT AS position, 1::BIGINT AS length, 'orphaned_combining_mark' AS type, 'error' AS severity FROM odd WHERE length(x) = 1 AND regexp_matches(x, '^[{RULE_MARK}]')
UNION ALL SELECT {key}, off + i, CASE WHEN nx IS NULL THEN 1 ELSE 2 END, 'invalid_coeng_usage', 'error' FROM nb WHERE c = chr(6098) AND (nx IS NULL OR NOT regexp_matches(nx, '[{RULE_CONSONANT}]'))
UNION ALL SELECT {key}, off + CASE WHEN i = 0 THEN 0 ELSE i - 1 END, CASE WHEN i = 0 THEN 1 ELSE 2 END, 'invalid_coeng_usage', 'error' FROM nb WHERE c = chr(6098) AND (pv IS NULL OR NOT regexp_matches(pv, '[{RULE_CONSONANT}]'))
UNION ALL SELECT {key}, any_value(off) + min(i), max(i) - min(i) + 1, 'invalid_vowel_combination', 'warning' FROM nb WHERE regexp_matches(c, '[{RULE_DEPENDENT}]') GROUP BY {key}, k HAVING count(*) > 1
UNION ALL SELECT {key}, i, 2, 'invalid_character_sequence', 'error' FROM ad WHERE regexp_matches(nx, '[{RULE_MARK}]') AND NOT regexp_matches(c, '[{RULE_CONSONANT}{RULE_VOWEL}{SPACE_RE2}]')
UNION ALL SELECT {key}, i, 2, 'invalid_unicode_sequence', 'error' FROM ad WHERE c = chr(6098) AND nx = chr(6098))"""


#: Error rows (doc_id, position, length, type, severity) of the corpus.
_RULES = f"{CORPUS}, {rule_ctes('corpus', 'doc_id')}"
_SUMS = f"{_RULES}, rs AS (SELECT c.doc_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, any_value(length(kt)) AS size FROM corpus c LEFT JOIN rule_rows USING (doc_id) GROUP BY c.doc_id)"


def rule_rows(spark, sf_dir):
    d = projected(spark, sf_dir)
    return R.error_rows(d, "doc_id", "kt", syllables("kt"))


def rule_sums(spark, sf_dir):
    return R.rule_summary(projected(spark, sf_dir), "doc_id", "kt", syllables("kt"))


@query(f"WITH {_RULES} SELECT doc_id, position, length, type, severity FROM rule_rows")
def rule_errors(spark, sf_dir):
    return rule_rows(spark, sf_dir)


@query(f"WITH {_SUMS} SELECT doc_id, n_errors, n_warnings, round(greatest(0.0, 1 - (2 * n_errors + n_warnings) / greatest(size, 1)), 6) AS rule_score, n_errors = 0 AS is_valid FROM rs")
def rule_scores(spark, sf_dir):
    return rule_sums(spark, sf_dir).drop("size").withColumn("rule_score", F.round("rule_score", 6))


@query(f"WITH {_RULES} SELECT type, severity, count(*) AS cnt, count(DISTINCT doc_id) AS texts FROM rule_rows GROUP BY ALL")
def rule_error_types(spark, sf_dir):
    return rule_rows(spark, sf_dir).groupBy("type", "severity").agg(F.count("*").alias("cnt"), F.count_distinct("doc_id").alias("texts"))


@query(f"""WITH {_SUMS}, t AS (SELECT type, count(*) AS n FROM rule_rows GROUP BY type) SELECT count(*) AS n_texts, count(*) FILTER (WHERE n_errors = 0) AS n_valid, sum(n_errors)::BIGINT AS n_errors, sum(n_warnings)::BIGINT AS n_warnings,
round(avg(greatest(0.0, 1 - (2 * n_errors + n_warnings) / greatest(size, 1))), 6) AS mean_score, round(count(*) FILTER (WHERE n_errors = 0) / count(*), 6) AS valid_rate, (SELECT string_agg(type || '=' || n, ',' ORDER BY n DESC, type) FROM t) AS by_type FROM rs""")
def rule_statistics(spark, sf_dir):
    """Statistics over all texts, types of errors most first."""
    out = R.batch_statistics(projected(spark, sf_dir), "kt", syllables("kt"))
    kinds = F.array_join(F.transform("by_type", lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string"))), ",")
    return out.withColumns({"mean_score": F.round("mean_score", 6), "valid_rate": F.round("valid_rate", 6), "by_type": kinds})


_BENCH_RULES = f"""bd AS (SELECT item_id, unnest(regexp_extract_all(kt, '(?s).')) AS c, generate_subscripts(regexp_extract_all(kt, '(?s).'), 1) - 1 AS i FROM bench),
ba AS (SELECT item_id, i, c, lead(c) OVER (PARTITION BY item_id ORDER BY i) AS nx FROM bd),
br AS (SELECT item_id, i AS position, 0.9 AS confidence, 'rule' AS source FROM ba WHERE regexp_matches(nx, '[{RULE_MARK}]') AND NOT regexp_matches(c, '[{RULE_CONSONANT}{RULE_VOWEL}{SPACE_RE2}]') UNION ALL SELECT item_id, i, 0.9, 'rule' FROM ba WHERE c = chr(6098) AND nx = chr(6098))"""
_CHAR = _SCORED.replace("scored AS", "cs AS")
#: Per item: rule, char and syllable scores. The character and syllable models have names of their own.
_TWO = f"""{CORPUS}, {_model('char', 3)}, {_CHAR}, {_BENCH_RULES}"""
_SYL = f"""{CORPUS}, {_model('syllable', 2)}, {_SYLL_SCORED}"""


def bench_scores(spark, sf_dir, whole: bool = False):
    """(item_id, size, ratio, n_errors, rule, char, syllable): the scores of the three validators for each benchmark text.

    whole: the rules look at syllables too, as in the hybrid validator; the ensemble looks at adjacent characters alone.
    """
    texts = bench_texts(spark, sf_dir)
    rule = R.rule_summary(texts, "item_id", "kt", syllables("kt") if whole else None)
    char = char_scored(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("probability") < 0.001).alias("char_errors"))
    syll = syllable_scored(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("probability") < 0.001).alias("syll_errors"), F.count("*").alias("syll_ngrams"))
    out = texts.select("item_id", T.char_ratio("kt").alias("ratio")).join(rule, "item_id").join(char, "item_id", "left").join(syll, "item_id", "left").fillna(0, ["char_errors", "syll_errors"])
    return out.select(
        "item_id", "size", "ratio", (F.col("n_errors") + F.col("char_errors") + F.col("syll_errors")).alias("n_errors"), F.col("rule_score").alias("rule"),
        (1 - F.col("char_errors") / F.greatest("size", F.lit(1))).alias("char"), F.coalesce(1 - F.col("syll_errors") / F.col("syll_ngrams"), F.lit(0.0)).alias("syllable"),
    )


def _three(whole: bool) -> str:
    rows = rule_ctes("bench", "item_id") if whole else f"{_BENCH_RULES}, rule_rows AS (SELECT item_id, 'error' AS severity FROM br)"
    n = lambda kind: f"(SELECT count(*) FROM rule_rows r WHERE r.item_id = b.item_id AND severity = '{kind}')"
    return f"""three AS (SELECT item_id, size, ratio, re + ce + se AS n_errors, greatest(0.0, 1 - (2.0 * re + rw) / greatest(size, 1)) AS rule, 1 - ce / greatest(size, 1) AS char, coalesce(1 - se / nullif(sn, 0), 0.0) AS syllable FROM
(WITH {CORPUS}, {_model('char', 3)}, {_CHAR}, {rows} SELECT b.item_id, length(b.kt) AS size, len(regexp_extract_all(b.kt, '[{SCRIPT}]')) / length(b.kt) AS ratio, {n('error')} AS re, {n('warning')} AS rw, (SELECT count(*) FROM cs WHERE cs.item_id = b.item_id AND p < 0.001) AS ce FROM bench b) a
JOIN (WITH {_SYL} SELECT b.item_id, count(*) FILTER (WHERE p < 0.001) AS se, count(p) AS sn FROM bench b LEFT JOIN scored USING (item_id) GROUP BY 1) s USING (item_id))"""


_THREE, _HYBRID = _three(False), _three(True)


@query(f"WITH {_HYBRID}, h AS (SELECT *, greatest(0.0, 1 - 4 * list_var_pop([rule, char, syllable])) AS agreed FROM three) SELECT item_id, round(0.4 * rule + 0.3 * char + 0.3 * syllable, 6) AS overall_score, round((char + syllable) / 2, 6) AS statistical_score, round(agreed, 6) AS consensus_score, round((1 + agreed) / 2, 6) AS confidence_score, n_errors = 0 AND 0.4 * rule + 0.3 * char + 0.3 * syllable > 0.7 AS hybrid_valid FROM h")
def hybrid_scores(spark, sf_dir):
    out = V.hybrid(bench_scores(spark, sf_dir, whole=True), "rule", "char", "syllable", "n_errors")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("item_id", r("overall_score"), r("statistical_score"), r("consensus_score"), r("confidence_score"), "hybrid_valid")


_LONG = f"{_THREE}, long AS (SELECT item_id, size, ratio, 'rule' AS model, rule AS score, 0.4 AS weight, 0.9 AS confidence FROM three UNION ALL SELECT item_id, size, ratio, 'char3', char, 0.15, 0.7 FROM three UNION ALL SELECT item_id, size, ratio, 'syll2', syllable, 0.15, 0.7 FROM three)"


def votes(spark, sf_dir):
    b = bench_scores(spark, sf_dir)
    one = lambda m, w, c, col: F.struct(F.lit(m).alias("model"), F.col(col).alias("score"), F.lit(w).alias("weight"), F.lit(c).alias("confidence"))
    return b.select("item_id", "size", "ratio", F.explode(F.array(one("rule", 0.4, 0.9, "rule"), one("char3", 0.15, 0.7, "char"), one("syll2", 0.15, 0.7, "syllable"))).alias("x")).select("item_id", "size", "ratio", "x.*")


def _rounded(df):
    return df.select("item_id", F.round("vote", 6).alias("vote"), F.round("vote_confidence", 6).alias("vote_confidence"))


@query(f"WITH {_LONG} SELECT item_id, round(sum(score * weight) / sum(weight), 6) AS vote, round(sum(score * weight * confidence) / sum(score * weight), 6) AS vote_confidence FROM long GROUP BY item_id")
def weighted_vote(spark, sf_dir):
    return _rounded(V.weighted_vote(votes(spark, sf_dir), "item_id"))


@query(f"WITH {_LONG} SELECT item_id, round(sum(score * weight * confidence) / sum(weight * confidence), 6) AS vote, round(sum(weight * confidence) / count(*), 6) AS vote_confidence FROM long GROUP BY item_id")
def confidence_vote(spark, sf_dir):
    return _rounded(V.confidence_vote(votes(spark, sf_dir), "item_id"))


@query(f"""WITH {_LONG}, d AS (SELECT item_id, score, confidence, weight * CASE WHEN model = 'rule' AND ratio > 0.8 THEN 1.2 WHEN model = 'rule' AND ratio < 0.5 THEN 0.7 WHEN size < 50 AND model IN ('char3', 'syll2') THEN 1.3 ELSE 1.0 END AS weight FROM long)
SELECT item_id, round(sum(score * weight * confidence) / sum(weight * confidence), 6) AS vote, round(sum(weight * confidence) / count(*), 6) AS vote_confidence FROM d GROUP BY item_id""")
def dynamic_vote(spark, sf_dir):
    return _rounded(V.confidence_vote(V.dynamic_weights(votes(spark, sf_dir), "ratio", "size"), "item_id"))


@query(f"""WITH {CORPUS}, t AS (SELECT length(kt) AS n, len(regexp_extract_all(kt, '[{SCRIPT}]')) / length(kt) AS r, row_number() OVER (ORDER BY doc_id) - 1 AS off, count(*) OVER () // 3 AS size FROM corpus),
f AS (SELECT CASE WHEN r > 0.8 AND n > 20 THEN 0.8 WHEN r > 0.5 THEN 0.6 ELSE 0.4 END AS base, least(off // size, 2) AS fold FROM t WHERE off - least(off // size, 2) * size < 20), m AS (SELECT fold, avg(base) AS base FROM f GROUP BY fold),
g AS (SELECT rw, (1.0 - rw) * cr AS ct, (row_number() OVER (ORDER BY rw, cr) - 1)::INTEGER AS rank FROM (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS rw), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS cr))
SELECT rank, rw AS rule_weight, round(ct, 6) AS char_total, round(avg(base * (least(rw, 0.5) + least(ct, 0.5))), 6) AS cv_score FROM g, m GROUP BY ALL""")
def weight_grid_cv(spark, sf_dir):
    d = projected(spark, sf_dir).select("doc_id", T.char_ratio("kt").alias("ratio"), F.length("kt").alias("size"))
    out = V.weight_search(d, "doc_id", "ratio", "size")
    return out.select("rank", "rule_weight", F.round("char_total", 6).alias("char_total"), F.round("cv_score", 6).alias("cv_score"))
