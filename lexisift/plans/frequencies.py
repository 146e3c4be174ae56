"""Queries of the frequency model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.scripts import DIGIT, SCRIPT, SPACE_RE2
from lexisift.functions.segment import filled, syllables
from lexisift.operators import frequency as Q
from lexisift.plans.registry import query
from lexisift.plans.sqltext import EACH, SYLLABLES, not_blank, strip
from lexisift.sources.corpus import projected

_PUNCT = T.PUNCTUATION.replace("'", "''")
_TYPE = f"""CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '^[{_PUNCT}{SPACE_RE2}]+\\z') THEN 'punctuation' WHEN regexp_matches(x, '^[{DIGIT}0-9]+\\z') THEN 'number'
WHEN regexp_matches(x, '^[{SCRIPT}]+\\z') THEN 'khmer' WHEN regexp_matches(x, '[{SCRIPT}]') THEN 'mixed' ELSE 'non_khmer' END"""
_COUNTS = f"{EACH}, counts AS (SELECT syllable, count(*) AS cnt FROM each GROUP BY 1), typed AS (SELECT syllable, cnt, {_TYPE} AS type FROM (SELECT *, {strip('syllable')} AS x FROM counts))"
_MODEL = f"{_COUNTS}, model AS (SELECT syllable, cnt FROM typed WHERE type IN ('khmer', 'mixed', 'punctuation') OR type = 'number' AND length(syllable) <= 1)"


def each(spark, sf_dir):
    return projected(spark, sf_dir).select("doc_id", F.explode(filled(syllables("kt"))).alias("syllable"))


def typed(spark, sf_dir):
    return Q.typed_counts(each(spark, sf_dir))


def model(spark, sf_dir):
    return typed(spark, sf_dir).where("included").select("syllable", "cnt")


@query(f"WITH {_COUNTS} SELECT type, count(*) AS types, sum(cnt)::BIGINT AS tokens FROM typed GROUP BY type")
def syllable_types(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("types"), F.sum("cnt").alias("tokens"))


@query(f"WITH {_COUNTS} SELECT type, syllable, cnt, type IN ('khmer', 'mixed', 'punctuation') OR type = 'number' AND length(syllable) <= 1 AS included FROM typed")
def syllable_type_counts(spark, sf_dir):
    return typed(spark, sf_dir).select("type", "syllable", "cnt", "included")


@query(f"""WITH {_MODEL} SELECT CASE WHEN cnt >= 100 THEN 'common' WHEN cnt BETWEEN 2 AND 10 THEN 'rare' WHEN cnt >= 2 THEN 'uncommon' ELSE 'unknown' END AS level, count(*) AS types, sum(cnt)::BIGINT AS tokens FROM model GROUP BY 1""")
def rarity_levels(spark, sf_dir):
    return model(spark, sf_dir).groupBy(Q.rarity(F.col("cnt")).alias("level")).agg(F.count("*").alias("types"), F.sum("cnt").alias("tokens"))


@query("""SELECT token AS syllable, CASE WHEN NOT regexp_matches(token, '^[\\x{17E0}-\\x{17E9}0-9]+$') THEN 'not_number' WHEN length(token) = 1 THEN CASE WHEN regexp_matches(token, '[0-9]') THEN 'single_arabic' ELSE 'single_khmer' END
WHEN regexp_matches(token, '[0-9]') AND regexp_matches(token, '[\\x{17E0}-\\x{17E9}]') THEN 'mixed_digits' WHEN regexp_matches(token, '[0-9]') THEN 'multi_arabic' ELSE 'multi_khmer' END AS number_type, count(*) AS cnt
FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token FROM documents) WHERE token <> '' AND regexp_matches(token, '[0-9]') GROUP BY ALL""")
def number_types(spark, sf_dir):
    d = projected(spark, sf_dir).select(F.explode(T.words("text")).alias("syllable")).where(F.col("syllable").rlike("[0-9]"))
    return d.groupBy("syllable").agg(F.count("*").alias("cnt")).withColumn("number_type", T.number_type("syllable"))


_CONTEXT = f"""{SYLLABLES}, fit AS (SELECT doc_id, unnest(list_filter(s, lambda x: {not_blank('x')} AND (regexp_matches(x, '[{SCRIPT}]') OR regexp_matches(x, '^[{_PUNCT}]+\\z') OR regexp_matches(x, '^[0-9]\\z')))) AS syllable, generate_subscripts(list_filter(s, lambda x: {not_blank('x')} AND (regexp_matches(x, '[{SCRIPT}]') OR regexp_matches(x, '^[{_PUNCT}]+\\z') OR regexp_matches(x, '^[0-9]\\z'))), 1) AS pos FROM lists),
before AS (SELECT syllable, lag(syllable) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM fit)"""


def context(spark, sf_dir):
    kept = F.filter(syllables("kt"), lambda x: x.rlike(T.INCLUDED))
    return Q.contexts(projected(spark, sf_dir).select("doc_id", kept.alias("s")), "doc_id", "s")


@query(f"WITH {_CONTEXT} SELECT syllable, prev, count(*) AS cnt FROM before WHERE prev IS NOT NULL GROUP BY ALL")
def prev_context(spark, sf_dir):
    return context(spark, sf_dir)


@query(f"""WITH {_CONTEXT}, counts AS (SELECT syllable, count(*) AS cnt FROM fit GROUP BY 1), seen AS (SELECT syllable, count(*) AS seen FROM before WHERE prev IS NOT NULL GROUP BY 1)
SELECT c.syllable, cnt, round(0.7 * cnt / (SELECT max(cnt) FROM counts) + 0.3 * least(coalesce(seen, 0) / 100, 1.0), 6) AS confidence_score FROM counts c LEFT JOIN seen USING (syllable)""")
def validate_syllables(spark, sf_dir):
    lists = projected(spark, sf_dir).select(syllables("kt").alias("s"))
    return Q.confidence(Q.places(lists, "s", T.INCLUDED)).withColumn("confidence_score", F.round("confidence_score", 6))


@query(f"""WITH {_MODEL}, u AS (SELECT syllable AS a FROM model WHERE cnt = 1), k AS (SELECT syllable AS b FROM model WHERE cnt >= 2),
p AS (SELECT a, b, len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] = x[2])) / greatest(length(a), length(b)) AS similarity FROM u, k WHERE a <> b AND least(length(a), length(b)) > 0.5 * greatest(length(a), length(b))),
r AS (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM p WHERE similarity > 0.5)
SELECT a AS syllable, rank, b AS suggestion, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def suggestions(spark, sf_dir):
    m = model(spark, sf_dir)
    out = Q.suggestions(m.where("cnt = 1"), m.where("cnt >= 2"))
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_MODEL} SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE coalesce(m.cnt, 0) >= 2) AS valid, round(count(*) FILTER (WHERE coalesce(m.cnt, 0) >= 2) / count(*), 6) AS validity_rate, count(*) FILTER (WHERE coalesce(m.cnt, 0) < 2) AS unknown
FROM each LEFT JOIN model m USING (syllable) GROUP BY doc_id""")
def text_validity(spark, sf_dir):
    return Q.text_validity(projected(spark, sf_dir), "kt").withColumn("validity_rate", F.round("validity_rate", 6))
