"""Queries of frequency tables and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.scripts import SCRIPT, SPACE_RE2
from lexisift.functions.segment import filled, syllables
from lexisift.operators import stats as S
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, EACH, SYLLABLES, not_blank
from lexisift.sources.corpus import projected, table

_CHARS = f"{CORPUS}, chars AS (SELECT doc_id, regexp_extract_all(kt, '[^{SPACE_RE2}]') AS a FROM corpus)"
_WORDS = f"{CORPUS}, wordlists AS (SELECT doc_id, regexp_extract_all(kt, '[^{SPACE_RE2}]+') AS a FROM corpus)"


def _grams(ctes: str, n: int, source: str) -> str:
    """Runs of n tokens by looking ahead."""
    ahead = "".join(f" || ' ' || lead(t, {k}) OVER w" for k in range(1, n))
    return f"WITH {ctes}, e AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS pos FROM {source}) SELECT token, count(*) AS cnt FROM (SELECT t{ahead} AS token FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE token IS NOT NULL GROUP BY token"


@query(f"WITH {_CHARS} SELECT token, count(*) AS cnt FROM (SELECT unnest(a) AS token FROM chars) GROUP BY token")
def char_freq(spark, sf_dir):
    return S.frequencies(projected(spark, sf_dir), S.characters("kt"))


@query(_grams(_CHARS, 2, "chars"))
def char_bigrams(spark, sf_dir):
    return S.char_ngram_counts(projected(spark, sf_dir), "kt", 2)


@query(_grams(_CHARS, 3, "chars"))
def char_trigrams(spark, sf_dir):
    return S.char_ngram_counts(projected(spark, sf_dir), "kt", 3)


@query(_grams(f"{SYLLABLES}, l AS (SELECT doc_id, s AS a FROM lists)", 2, "l"))
def syllable_bigrams(spark, sf_dir):
    """White space takes part in pairs."""
    return S.frequencies(T.held(projected(spark, sf_dir), "a", syllables("kt")), S.ngrams(F.col("a"), 2))


@query(f"WITH {EACH} SELECT syllable AS token, count(*) AS cnt FROM each GROUP BY syllable")
def syllable_freq(spark, sf_dir):
    return S.frequencies(projected(spark, sf_dir), filled(syllables("kt")))


@query(f"WITH {_WORDS} SELECT token, count(*) AS cnt FROM (SELECT unnest(a) AS token FROM wordlists) GROUP BY token")
def word_freq(spark, sf_dir):
    return S.frequencies(projected(spark, sf_dir), T.words("kt"))


@query(_grams(_WORDS, 2, "wordlists"))
def word_bigrams(spark, sf_dir):
    return S.frequencies(T.held(projected(spark, sf_dir), "a", T.words("kt")), S.ngrams(F.col("a"), 2))


@query(f"WITH {EACH} SELECT length(syllable)::BIGINT AS length, count(*)::BIGINT AS cnt FROM each GROUP BY 1")
def length_hist(spark, sf_dir):
    return S.length_histogram(syllable_freq(spark, sf_dir))


@query(f"WITH {_CHARS} SELECT token, count(*) AS cnt FROM (SELECT unnest(a) AS token FROM chars) GROUP BY token HAVING count(*) <= 5 ORDER BY token LIMIT 20")
def rare_chars(spark, sf_dir):
    return S.rare(char_freq(spark, sf_dir))


@query(f"WITH {_WORDS} SELECT token, count(*) AS cnt FROM (SELECT unnest(a) AS token FROM wordlists) GROUP BY token ORDER BY cnt DESC, token LIMIT 100")
def word_topk(spark, sf_dir):
    return S.top(word_freq(spark, sf_dir), 100)


_FREQS = f"""c AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(kt, '[^{SPACE_RE2}]')) AS token FROM corpus) GROUP BY token),
w AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(kt, '[^{SPACE_RE2}]+')) AS token FROM corpus) GROUP BY token),
s AS (SELECT syllable AS token, count(*) AS cnt FROM each GROUP BY syllable)"""
_DIVERSITY = "(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt)) / log2(count(*))"


@query(f"""WITH {EACH}, {_FREQS},
a AS (SELECT sum(cnt)::BIGINT AS total, count(*) AS types, sum(cnt) FILTER (WHERE regexp_matches(token, '^[{SCRIPT}]+$'))::BIGINT AS script FROM c),
b AS (SELECT sum(cnt)::BIGINT AS total, count(*) AS types, sum(length(token) * cnt) / sum(cnt) AS mean_length, {_DIVERSITY} AS diversity, count(*) FILTER (WHERE length(token) > 15) AS compounds FROM w),
d AS (SELECT sum(cnt)::BIGINT AS total, count(*) AS types, sum(length(token) * cnt) / sum(cnt) AS mean_length, count(*) FILTER (WHERE len(regexp_extract_all(token, '[{SCRIPT}]')) > 2) AS compounds FROM s)
SELECT (SELECT count(*) FROM documents) AS texts, (SELECT sum(octet_length(encode(kt))) FROM corpus)::BIGINT AS bytes, a.total AS chars, a.types AS char_types, b.total AS words, b.types AS word_types, d.total AS syllables, d.types AS syllable_types,
round(b.mean_length, 6) AS mean_word, round(d.mean_length, 6) AS mean_syllable, b.compounds AS long_words, d.compounds AS compound_syllables, round(a.script / a.total, 6) AS script_share, round(b.types / b.total, 6) AS vocabulary_coverage, round(b.diversity, 6) AS text_diversity,
round(0.3 * a.script / a.total + 0.25 * least(b.types / 10000, 1.0) + 0.25 * least(d.types / 5000, 1.0) + 0.2 * least(a.types / 200, 1.0), 6) AS quality_score FROM a, b, d""")
def corpus_stats(spark, sf_dir):
    """One row; the three one-row aggregates are joined without keys."""
    d = projected(spark, sf_dir)
    a = S.token_statistics(char_freq(spark, sf_dir))
    words = word_freq(spark, sf_dir)
    b = S.token_statistics(words, compound=F.length("token") > 15)
    c = S.token_statistics(syllable_freq(spark, sf_dir))
    prefixed = lambda f, p: f.select(*(F.col(x).alias(p + x) for x in f.columns))
    whole = d.agg(F.count("*").alias("texts"), F.sum(F.octet_length("kt")).alias("bytes"))
    one = whole.join(prefixed(a, "c_")).join(prefixed(b, "w_")).join(prefixed(c, "s_")).join(S.entropy(words).select("diversity"))
    r = lambda x: F.round(x, 6)
    most = lambda x, n: F.least(F.col(x) / n, F.lit(1.0))
    return one.select(
        "texts", F.col("bytes").cast("bigint").alias("bytes"), F.col("c_total").alias("chars"), F.col("c_types").alias("char_types"), F.col("w_total").alias("words"), F.col("w_types").alias("word_types"),
        F.col("s_total").alias("syllables"), F.col("s_types").alias("syllable_types"), r("w_mean_length").alias("mean_word"), r("s_mean_length").alias("mean_syllable"), F.col("w_compounds").alias("long_words"),
        F.col("s_compounds").alias("compound_syllables"), r("c_script_share").alias("script_share"), r(F.col("w_types") / F.col("w_total")).alias("vocabulary_coverage"), r("diversity").alias("text_diversity"),
        r(0.3 * F.col("c_script_share") + 0.25 * most("w_types", 10000) + 0.25 * most("s_types", 5000) + 0.2 * most("c_types", 200)).alias("quality_score"),
    )


@query(f"WITH {EACH}, {_FREQS} SELECT 'word' AS kind, count(*) AS types, sum(cnt)::BIGINT AS tokens, round({_DIVERSITY}, 6) AS diversity FROM w UNION ALL SELECT 'syllable', count(*), sum(cnt)::BIGINT, round({_DIVERSITY}, 6) FROM s")
def text_diversity(spark, sf_dir):
    one = lambda f, kind: S.entropy(f).select(F.lit(kind).alias("kind"), "types", "tokens", F.round("diversity", 6).alias("diversity"))
    return one(word_freq(spark, sf_dir), "word").unionByName(one(syllable_freq(spark, sf_dir), "syllable"))


@query(f"""WITH {EACH}, f AS (SELECT syllable, count(*) AS cnt FROM each GROUP BY 1), r AS (SELECT cnt, sum(cnt) OVER (ORDER BY cnt DESC, syllable ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY cnt DESC, syllable) AS rn, sum(cnt) OVER () AS total FROM f)
SELECT share::INTEGER AS share, (SELECT min(rn) FROM r WHERE run >= share * total / 100)::BIGINT AS types FROM (SELECT unnest([50, 75, 90, 95, 99]) AS share)""")
def coverage_percentiles(spark, sf_dir):
    return S.coverage(syllable_freq(spark, sf_dir))


_SEEN = f"{SYLLABLES}, seen AS (SELECT doc_id, unnest(s) AS token, generate_subscripts(s, 1) - 1 AS pos FROM lists), firsts AS (SELECT token, min({{'d': doc_id, 'p': pos}}) AS f, count(*) AS cnt FROM seen WHERE {not_blank('token')} GROUP BY token)"


def _seen(spark, sf_dir):
    out = S.first_seen(projected(spark, sf_dir), "doc_id", syllables("kt")).where(F.col("token").rlike(r"\S"))
    return out.withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query(f"WITH {_SEEN} SELECT token, f.d AS first_doc, f.p::BIGINT AS first_pos, cnt FROM firsts")
def unique_tokens(spark, sf_dir):
    return _seen(spark, sf_dir)


@query(f"WITH {_SEEN} SELECT token, f.d AS first_doc, f.p::BIGINT AS first_pos, cnt FROM firsts WHERE regexp_matches(token, '^[{SCRIPT}]+\\z')")
def khmer_only_tokens(spark, sf_dir):
    return _seen(spark, sf_dir).where(F.col("token").rlike(rf"^[{SCRIPT}]+\z"))


@query(f"WITH {_SEEN} SELECT token FROM firsts EXCEPT SELECT token FROM firsts WHERE regexp_matches(token, '^[{SCRIPT}]+\\z')")
def non_khmer_tokens(spark, sf_dir):
    """All tokens less those of the script alone: an anti-join on the token."""
    return unique_tokens(spark, sf_dir).select("token").join(khmer_only_tokens(spark, sf_dir).select("token"), "token", "left_anti")


@query(f"WITH {CORPUS} SELECT doc_id, length(kt)::BIGINT AS length, len(list_distinct(string_split(kt, '')))::BIGINT AS unique_chars, round(len(regexp_extract_all(kt, '[{SCRIPT}]')) / length(kt), 6) AS khmer_ratio, round((least(length(kt) / 100, 1.0) + len(list_distinct(string_split(kt, ''))) / length(kt)) / 2, 6) AS complexity FROM corpus")
def text_complexity(spark, sf_dir):
    n = F.length("kt")
    distinct = F.size(F.array_distinct(F.regexp_extract_all("kt", F.lit(r"(?s)."), 0)))
    return projected(spark, sf_dir).select("doc_id", n.cast("bigint").alias("length"), distinct.cast("bigint").alias("unique_chars"), F.round(T.char_ratio("kt"), 6).alias("khmer_ratio"), F.round((F.least(n / 100, F.lit(1.0)) + distinct / n) / 2, 6).alias("complexity"))


@query(f"WITH {SYLLABLES} SELECT round(avg(length(kt)), 6) AS chars_per_text, round(avg(len(s)), 6) AS syllables_per_text, round(avg(length(kt)) / avg(len(s)), 6) AS sequence_efficiency FROM lists")
def model_comparison(spark, sf_dir):
    n, s = F.avg(F.length("kt")), F.avg(F.size(syllables("kt")))
    return projected(spark, sf_dir).agg(F.round(n, 6).alias("chars_per_text"), F.round(s, 6).alias("syllables_per_text"), F.round(n / s, 6).alias("sequence_efficiency"))


@query("SELECT count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, arg_max(doc_id, {'n': n_chars, 'd': -doc_id}) AS largest, arg_min(doc_id, {'n': n_chars, 'd': doc_id}) AS smallest FROM documents")
def file_corpus_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(
        F.count("*").alias("files"),
        F.sum(F.octet_length("text")).cast("bigint").alias("bytes"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("lines"),
        F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("largest"),
        F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("smallest"),
    )


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, round(avg(value), 4) AS mean_value, round(count(*) / 60.0, 4) AS per_minute, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def service_metrics(spark, sf_dir):
    """Request-log metrics by the hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("requests"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.count("*") / 60.0, 4).alias("per_minute"), F.count_if(F.col("event_type") == "error").alias("errors"))
