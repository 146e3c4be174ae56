"""Queries of synthetic tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexisift.operators import synth as Y
from lexisift.plans.registry import query
from lexisift.plans.statistics import unique_tokens

_L = lambda values, name: f"{name} AS (SELECT unnest([{', '.join(map(_Q, values))}]) AS {name})"
_Q = "'{}'".format
_T = lambda values, name: f"(SELECT unnest([{', '.join(map(_Q, values))}]) AS {name})"
_V = lambda vowels: _T(["", *vowels], "v")
_C = "chr(6098)"
_MULTI = f"""double_ AS (SELECT substr(p, 1, 1) || {_C} || substr(p, 2, 1) || {_C} || substr(p, 3, 1) AS token FROM {_T(Y.DOUBLE_PATTERNS, 'p')} UNION SELECT a || {_C} || b || {_C} || c FROM {_T(Y.DOUBLE_BASES, 'a')}, {_T(Y.DOUBLE_MIDDLES, 'b')}, {_T(Y.DOUBLE_ENDS, 'c')} WHERE a <> b AND a <> c AND b <> c),
triple AS (SELECT substr(p, 1, 1) || {_C} || substr(p, 2, 1) || {_C} || substr(p, 3, 1) AS token FROM {_T(Y.TRIPLE_PATTERNS, 'p')} UNION SELECT a || {_C} || substr(e, 1, 1) || {_C} || substr(e, 2, 1) FROM {_T(Y.TRIPLE_BASES, 'a')}, {_T(Y.TRIPLE_ENDS, 'e')} WHERE NOT contains(e, a))"""
_ALL = f"""{_MULTI}, {_L(Y.CONSONANTS, 'c')}, {_L(Y.VOWELS, 'v')}, {_L(Y.DIACRITICS, 'd')}, {_L(Y.INDEPENDENT, 'i')}, {_L(Y.DIGITS, 'n')}, s AS (SELECT c AS s FROM c), m AS (SELECT n AS m FROM n),
fam AS (SELECT 'consonant' AS family, c AS token FROM c UNION ALL SELECT 'consonant_vowel', c || v FROM c, v UNION ALL SELECT 'consonant_vowel_diacritic', c || v || d FROM c, v, d UNION ALL SELECT 'consonant_diacritic', c || d FROM c, d
UNION ALL SELECT 'independent', i FROM i UNION ALL SELECT 'independent', i || d FROM i, d UNION ALL SELECT 'cluster', c || chr(6098) || s FROM c, s WHERE c <> s UNION ALL SELECT 'cluster_vowel', c || chr(6098) || s || v FROM c, s, v WHERE c <> s
UNION ALL SELECT 'cluster_vowel_diacritic', c || chr(6098) || s || v || d FROM (SELECT unnest([{', '.join(map(_Q, Y.CONSONANTS[:15]))}]) AS c), (SELECT unnest([{', '.join(map(_Q, Y.CONSONANTS[:10]))}]) AS s), (SELECT unnest([{', '.join(map(_Q, Y.LIMITED_VOWELS))}]) AS v), (SELECT unnest([{', '.join(map(_Q, Y.LIMITED_DIACRITICS))}]) AS d) WHERE c <> s
UNION ALL SELECT 'digits', n FROM n UNION ALL SELECT 'digits', n || m FROM n, m
UNION ALL SELECT 'double', token || v FROM double_, {_V(Y.DOUBLE_VOWELS)} UNION ALL SELECT 'triple', token || v FROM triple, {_V(Y.TRIPLE_VOWELS)} UNION ALL SELECT 'documented', token FROM {_T(Y.DOCUMENTED, 'token')}), toks AS (SELECT DISTINCT token FROM fam)"""


@query(f"WITH {_ALL} SELECT token FROM toks")
def synthetic_tokens(spark, sf_dir):
    return Y.all_tokens(spark)


@query(f"WITH {_ALL} SELECT family, count(*) AS tokens, count(DISTINCT token) AS types FROM fam GROUP BY family")
def synthetic_families(spark, sf_dir):
    rows = [d.agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("types")).select(F.lit(k).alias("family"), "tokens", "types") for k, d in Y.families(spark).items()]
    return reduce(lambda a, b: a.union(b), rows)


@query(f"WITH {_ALL} SELECT length(token)::BIGINT AS length, count(*) AS tokens, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM toks GROUP BY 1")
def synthetic_length_hist(spark, sf_dir):
    from pyspark.sql import Window

    n = Y.all_tokens(spark).groupBy(F.length("token").cast("bigint").alias("length")).agg(F.count("*").alias("tokens"))
    return n.withColumn("percent", F.round(F.col("tokens") * 100 / F.sum("tokens").over(Window.partitionBy()), 6))


@query(f"WITH {_ALL} SELECT ch, count(*) AS cnt FROM (SELECT unnest(string_split(token, '')) AS ch FROM toks) GROUP BY ch")
def synthetic_char_usage(spark, sf_dir):
    return Y.all_tokens(spark).select(F.explode(F.regexp_extract_all("token", F.lit("(?s)."), 0)).alias("ch")).groupBy("ch").agg(F.count("*").alias("cnt"))


@query(f"WITH {_MULTI} SELECT token FROM double_")
def synthetic_double_clusters(spark, sf_dir):
    return Y.double_clusters(spark)


@query(f"WITH {_MULTI} SELECT token FROM triple")
def synthetic_triple_clusters(spark, sf_dir):
    return Y.triple_clusters(spark)


@query(f"WITH {_ALL} SELECT family, token FROM fam WHERE family IN ('double', 'triple', 'documented')")
def synthetic_multi_subscripts(spark, sf_dir):
    """Clusters of three consonants with vowels, and documented words."""
    parts = Y.families(spark)
    return reduce(lambda a, b: a.union(b), (parts[k].select(F.lit(k).alias("family"), "token") for k in Y.MULTI))


_FLAGS = "(SELECT unnest([true, false]) AS clusters), (SELECT unnest([true, false]) AS complex), (SELECT unnest([true, false]) AS multi)"


@query(f"""WITH {_ALL} SELECT clusters, complex, multi, count(DISTINCT token) AS tokens FROM fam, {_FLAGS}
WHERE (clusters OR family NOT IN ('cluster', 'cluster_vowel', 'cluster_vowel_diacritic')) AND (complex OR family NOT IN ('consonant_vowel_diacritic', 'cluster_vowel_diacritic')) AND (multi OR family NOT IN ('double', 'triple', 'documented')) GROUP BY ALL""")
def synthetic_flags(spark, sf_dir):
    """How many tokens each choice of the three flags gives."""
    rows = reduce(lambda a, b: a.union(b), (d.select(F.lit(k).alias("family"), "token") for k, d in Y.families(spark).items()))
    for name in ("clusters", "complex", "multi"):
        rows = rows.withColumn(name, F.explode(F.array(F.lit(True), F.lit(False))))
    left = (F.col("clusters") | ~F.col("family").isin(*Y.CLUSTERS, "cluster_vowel_diacritic")) & (F.col("complex") | ~F.col("family").isin(*Y.COMPLEX)) & (F.col("multi") | ~F.col("family").isin(*Y.MULTI))
    return rows.where(left).groupBy("clusters", "complex", "multi").agg(F.count_distinct("token").alias("tokens"))


from lexisift.plans.statistics import _SEEN  # noqa: E402


@query(f"WITH {_SEEN}, {_ALL} SELECT token, cnt FROM firsts WHERE token IN (SELECT token FROM toks)")
def synthetic_seen(spark, sf_dir):
    """Synthetic tokens that the corpus has: a semi-join on the token."""
    return unique_tokens(spark, sf_dir).select("token", "cnt").join(Y.all_tokens(spark), "token", "left_semi")
