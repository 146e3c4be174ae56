"""Queries of the rest of the library's functions: predicates, usage, samples, sites, service metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexisift import service
from lexisift.functions import text as T
from lexisift.functions.scripts import METHODS, SCRIPT, SPACE_RE2
from lexisift.functions.segment import joined, method_groups, segment, syllables, usage
from lexisift.operators import frequency as Q
from lexisift.operators import ngrams as N
from lexisift.operators import vocab as V
from lexisift.plans import frequencies as fr
from lexisift.plans import vocabularies as vo
from lexisift.plans.cleaning import quality_sql
from lexisift.plans.frequencies import _CONTEXT, _MODEL
from lexisift.plans.models import _GT, _SCORED, _model, bench_texts, char_model
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, not_blank, tokens
from lexisift.plans.vocabularies import _FAST
from lexisift.sources import files, sites
from lexisift.sources.corpus import projected, table

_S = SPACE_RE2


@query(f"""WITH {CORPUS}, m AS (SELECT doc_id, kt, {quality_sql('kt')} FROM corpus) SELECT doc_id, quality_score >= 0.7 AS high_quality, length(kt) > 0 AND len(regexp_extract_all(kt, '[{SCRIPT}]')) / length(kt) >= 0.5 AS mostly_script,
round(CASE WHEN length(kt) = 0 THEN 0.0 ELSE (least(length(kt) / 100, 1.0) + len(list_distinct(string_split(kt, ''))) / length(kt)) / 2 END, 6) AS complexity FROM m""")
def text_predicates(spark, sf_dir):
    d = T.with_quality(projected(spark, sf_dir), "kt")
    return d.select("doc_id", T.high_quality(F.col("quality_score")).alias("high_quality"), T.mostly_script("kt").alias("mostly_script"), F.round(T.complexity("kt"), 6).alias("complexity"))


@query(f"WITH {CORPUS}, j AS (SELECT doc_id, array_to_string({tokens('regex_basic')}, ' ') AS t FROM corpus) SELECT doc_id, md5(replace(replace(replace(t, '  ', '<<<DOUBLE_SPACE>>>'), ' ', ''), '<<<DOUBLE_SPACE>>>', '  ')) AS restored FROM j")
def restored_text(spark, sf_dir):
    """Texts put together again from their syllables parted by spaces."""
    d = T.held(projected(spark, sf_dir), "t", joined("kt", "regex_basic", " "))
    return d.select("doc_id", F.md5(T.restored("t")).alias("restored"))


@query(f"SELECT count(*) AS texts, count(text) AS successes, round(count(text) / count(*), 6) AS success_rate, sum(CASE WHEN {not_blank('text')} THEN len({tokens(text='text')}) ELSE 0 END)::BIGINT AS syllables FROM conversations")
def segment_usage(spark, sf_dir):
    return usage(segment(table(spark, sf_dir, "conversations"))).withColumn("success_rate", F.round("success_rate", 6))


@query(f"WITH {CORPUS}, p AS (SELECT doc_id, unnest(string_split(kt, chr(10))) AS t, generate_subscripts(string_split(kt, chr(10)), 1) - 1 AS pos FROM corpus), m AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, md5(array_to_string({tokens(m, 't')}, '|')) AS digest FROM p" for m in METHODS) + ") SELECT doc_id, groups, count(*) AS paragraphs FROM (SELECT doc_id, pos, count(DISTINCT digest) AS groups FROM m GROUP BY ALL) GROUP BY ALL")
def paragraph_method_groups(spark, sf_dir):
    """How many paragraphs of a text the methods segment in one, two or more ways."""
    p = projected(spark, sf_dir).select("doc_id", F.posexplode(F.split("kt", "\n")).alias("pos", "t")).select(F.struct("doc_id", "pos").alias("place"), "t")
    groups = method_groups(p, "place", "t").groupBy("place").agg(F.count("*").alias("groups"))
    return groups.groupBy(F.col("place.doc_id").alias("doc_id"), "groups").agg(F.count("*").alias("paragraphs"))


# The frequency model


def _lists(spark, sf_dir):
    return projected(spark, sf_dir).select("doc_id", F.filter(syllables("kt"), lambda x: x.rlike(T.INCLUDED)).alias("s"))


@query(f"WITH {_CONTEXT}, t AS (SELECT lag(syllable, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS s1, lag(syllable) OVER (PARTITION BY doc_id ORDER BY pos) AS s2, syllable AS s3 FROM fit) SELECT s1, s2, s3, count(*) AS cnt FROM t WHERE s1 IS NOT NULL GROUP BY ALL")
def syllable_trigrams(spark, sf_dir):
    return Q.runs(_lists(spark, sf_dir), "s", 3)


@query(f"WITH {_MODEL} SELECT syllable, cnt FROM model")
def incremental_counts(spark, sf_dir):
    """The frequency model trained on one language after another."""
    rows = projected(spark, sf_dir).select("lang", F.explode(syllables("kt")).alias("syllable")).where(F.col("syllable").rlike(T.INCLUDED))
    each = rows.groupBy("lang", "syllable").agg(F.count("*").alias("cnt"))
    langs = [r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]  # a few languages
    return reduce(Q.merged, (each.where(F.col("lang").eqNullSafe(F.lit(k))) for k in langs))


@query(f"WITH {_MODEL} SELECT sum(cnt)::BIGINT AS total_syllables, count(*) AS unique_syllables, (SELECT count(*) FROM documents) AS texts, round(sum(cnt) / (SELECT count(*) FROM documents), 6) AS mean_of_text, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS entropy FROM model")
def frequency_summary(spark, sf_dir):
    out = Q.summary(fr.model(spark, sf_dir), table(spark, sf_dir, "documents").count())
    return out.withColumns({"mean_of_text": F.round("mean_of_text", 6), "entropy": F.round("entropy", 6)})


@query(f"WITH {_MODEL}, c AS (SELECT 'common' AS kind, row_number() OVER (ORDER BY cnt DESC, syllable) AS rank, syllable, cnt FROM model), r AS (SELECT 'rare' AS kind, row_number() OVER (ORDER BY cnt, syllable) AS rank, syllable, cnt FROM model WHERE cnt <= 10) SELECT kind, rank::INTEGER AS rank, syllable, cnt FROM (SELECT * FROM c UNION ALL SELECT * FROM r) WHERE rank <= 50")
def frequency_extremes(spark, sf_dir):
    """The 50 most common and 50 rare syllables, as the report shows."""
    return Q.extremes(fr.model(spark, sf_dir))


# Vocabularies


@query(f"WITH {CORPUS}, {_FAST}, t AS (SELECT token, cnt FROM voc ORDER BY cnt DESC, token LIMIT 10) SELECT 'length' AS kind, length(token)::VARCHAR AS name, count(*) AS n FROM voc GROUP BY ALL UNION ALL SELECT 'frequent', token, cnt FROM t")
def vocab_info(spark, sf_dir):
    return V.info(vo._vocabulary(spark, sf_dir))


@query(f"WITH {CORPUS}, {_FAST} SELECT token, coalesce(id, -1) AS id, fq.cnt, id IS NOT NULL AS known, len(regexp_extract_all(token, '[{SCRIPT}]')) / length(token) >= 0.5 AS script FROM fq LEFT JOIN (SELECT token, id FROM voc) USING (token)")
def syllable_info(spark, sf_dir):
    freq = vo._freq(spark, sf_dir)
    return V.token_info(freq, freq, vo._vocabulary(spark, sf_dir), T.mostly_script("token"))


_CHARS = f"f AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(kt, '[^{_S}]')) AS token FROM corpus) GROUP BY token), cv AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id, cnt FROM f WHERE cnt >= 2 AND regexp_matches(token, '^[{SCRIPT}]+$'))"


@query(f"WITH {CORPUS}, {_CHARS} SELECT token, id, cnt FROM cv")
def script_char_vocab(spark, sf_dir):
    from lexisift.plans.statistics import char_freq

    return V.build(char_freq(spark, sf_dir), script_only=True)


@query(f"WITH {CORPUS}, {_CHARS}, e AS (SELECT doc_id, pos, t FROM (SELECT doc_id, unnest(string_split(kt, '')) AS t, generate_subscripts(string_split(kt, ''), 1) - 1 AS pos FROM corpus) WHERE pos < 100), l AS (SELECT doc_id, string_agg(t, '' ORDER BY pos) AS text FROM e JOIN cv ON token = t GROUP BY doc_id) SELECT doc_id, coalesce(l.text, '') AS text FROM documents LEFT JOIN l USING (doc_id)")
def char_decode(spark, sf_dir):
    """The first hundred characters as ids and back: unknown ones are gone, and the text ends at its padding."""
    v = script_char_vocab(spark, sf_dir)
    lists = projected(spark, sf_dir).select("doc_id", F.regexp_extract_all("kt", F.lit("(?s)."), 0).alias("s"))
    return V.decode(V.encode(lists, "doc_id", "s", v, 100), "doc_id", v, stop_at_padding=True)


@query(f"WITH {CORPUS}, {_FAST}, w AS (SELECT doc_id, i // 25 AS k FROM (SELECT doc_id, unnest(range(0, len(s) - 50, 25)) AS i FROM fast)), p AS (SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id || '-' || k), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'valid' END AS part FROM w) SELECT part, count(*) AS windows, count(DISTINCT doc_id) AS texts FROM p GROUP BY part")
def train_split(spark, sf_dir):
    """Training windows by side."""
    lists = T.held(projected(spark, sf_dir), "s", vo.filled(syllables("kt", "no_regex_fast")))
    w = lists.select("doc_id", F.posexplode(V.windows(F.col("s"), 50)).alias("k", "w"))
    return V.split(w, "doc_id", "k").groupBy("part").agg(F.count("*").alias("windows"), F.count_distinct("doc_id").alias("texts"))


# N-gram models


@query(f"""WITH {CORPUS}, {_model('char', 3)}, {_SCORED}, {_GT}, o AS (SELECT count(*) FILTER (WHERE cnt = 1) AS once FROM ng), x AS (SELECT item_id, cnt, ccnt, adjusted, v, total, CASE WHEN once > 0 THEN once / total ELSE 1.0 / (total + v) END AS c0 FROM h LEFT JOIN ng USING (ngram) LEFT JOIN cx ON cx.context = h.context LEFT JOIN gt USING (cnt), sizes, o WHERE h.ngram IS NOT NULL)
SELECT item_id, 'good_turing' AS method, round(avg(ln(CASE WHEN ccnt > 0 THEN coalesce(adjusted, c0) / ccnt ELSE c0 END)), 6) AS log_probability FROM x GROUP BY item_id UNION ALL SELECT item_id, 'simple_backoff', round(avg(ln(CASE WHEN cnt > 0 THEN cnt / ccnt ELSE 0.4 / v END)), 6) FROM x GROUP BY item_id""")
def smoothed_text_scores(spark, sf_dir):
    """Text scores by the smoothing methods that treat unseen n-grams and contexts in their own way."""
    m, texts = char_model(spark, sf_dir), bench_texts(spark, sf_dir)
    parts = [N.text_scores(texts, "item_id", N.scored(texts, "item_id", N.char_units("kt", 3), m, k), "kt").select("item_id", F.lit(k).alias("method"), F.round("log_probability", 6).alias("log_probability")) for k in ("good_turing", "simple_backoff")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"""WITH {CORPUS}, c AS (SELECT length(kt) AS n, len(regexp_extract_all(kt, '[{SCRIPT}]')) AS s, len(regexp_extract_all(kt, '[{_S}]')) AS w, len(regexp_extract_all(kt, '[។៕៖ៗ]')) AS p FROM corpus)
SELECT sum(n)::BIGINT AS total_chars, round(sum(s) / sum(n), 6) AS khmer_ratio, round(sum(n - s - w) / sum(n), 6) AS filter_ratio, round(sum(w) / sum(n), 6) AS space_ratio, round(sum(p) / sum(n), 6) AS punct_ratio, round(count(*) FILTER (WHERE s >= 0.5 * (n - w) AND n > w) / count(*), 6) AS text_retention_ratio FROM c""")
def filter_statistics(spark, sf_dir):
    """What filtering by the script, at half of a text's characters, leaves of the corpus."""
    return N.filter_statistics(projected(spark, sf_dir), "kt", 0.5).select("total_chars", *(F.round(c, 6).alias(c) for c in ("khmer_ratio", "filter_ratio", "space_ratio", "punct_ratio", "text_retention_ratio")))


# Pages and the service


@query("""WITH l AS (SELECT page_id, unnest(u) AS href, generate_subscripts(u, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages)), w AS (SELECT 'voa' AS site, CASE WHEN starts_with(href, '/') THEN 'https://www.voakhmernews.com' || href ELSE href END AS link, page_id, pos FROM l WHERE contains(href, '/a/')
UNION ALL SELECT 'khmertimes', href, page_id, pos FROM l WHERE regexp_matches(href, '/[0-9]{4}/[0-9]{2}/[0-9]{2}/') UNION ALL SELECT 'rfa', CASE WHEN starts_with(href, '/') THEN 'https://www.rfa.org' || href ELSE href END, page_id, pos FROM l WHERE starts_with(href, '/khmer/') AND contains(href, '/news/')
UNION ALL SELECT 'any', href, page_id, pos FROM l WHERE contains(href, '/'))
SELECT site, link, min({'a': page_id, 'b': pos}).a AS first_page FROM w GROUP BY ALL""")
def site_links(spark, sf_dir):
    """The article links of the pages by each site's rule, and by one that takes any link."""
    pages = table(spark, sf_dir, "pages")
    profiles = sites.SITES | {"any": sites.Site("any", "", (), lambda u: F.contains(u, F.lit("/")))}
    parts = [sites.article_links(pages, p).select(F.lit(k).alias("site"), "link", "first_page") for k, p in profiles.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS mean_seconds, round(count(*) / greatest(date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))), 1), 6) AS throughput, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate, round(1 - count(DISTINCT (user_id, event_type)) / count(*), 6) AS cache_hit_rate FROM events")
def service_summary(spark, sf_dir):
    """Request-log metrics as a whole; a request is a user's event of a kind."""
    out = service.metrics(table(spark, sf_dir, "events"), "ts", "value", ["user_id", "event_type"], F.col("event_type") == "error")
    return out.select("requests", "errors", F.round("mean_seconds", 4).alias("mean_seconds"), *(F.round(c, 6).alias(c) for c in ("throughput", "error_rate", "cache_hit_rate")))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS ms, count(*) / 3600 AS t, count(*) FILTER (WHERE event_type = 'error') / count(*) AS e FROM events GROUP BY 1)
SELECT hour, CASE WHEN ms < 10 THEN 'Excellent' WHEN ms < 50 THEN 'Good' WHEN ms < 100 THEN 'Acceptable' ELSE 'Needs improvement' END AS latency, CASE WHEN t > 1000 THEN 'Excellent' WHEN t > 500 THEN 'Good' WHEN t > 100 THEN 'Acceptable' ELSE 'Needs improvement' END AS throughput,
CASE WHEN e < 0.1 THEN 'Excellent' WHEN e < 0.3 THEN 'Good' WHEN e < 0.5 THEN 'Acceptable' ELSE 'High' END AS errors FROM h""")
def service_rating(spark, sf_dir):
    """How the service did by the hour; values count as milliseconds."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("ms"), (F.count("*") / 3600).alias("t"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("e"))
    return e.withColumn("r", service.rating(F.col("ms"), F.col("t"), F.col("e"))).select("hour", "r.latency", "r.throughput", "r.errors")


@query(f"""WITH {CORPUS}, l AS (SELECT doc_id, kt FROM corpus ORDER BY doc_id LIMIT 100), t AS (SELECT unnest({tokens(text="kt")}) AS token FROM l) SELECT count(*) AS tokens, count(*) FILTER (WHERE regexp_matches(token, '^[{SCRIPT}]+\\z')) AS script_tokens, round(count(*) FILTER (WHERE regexp_matches(token, '^[{SCRIPT}]+\\z')) / count(*), 6) AS script_share FROM t WHERE {not_blank('token')}""")
def token_sample(spark, sf_dir):
    """Tokens of the first hundred texts, as the report shows."""
    return files.token_sample(projected(spark, sf_dir), "kt", "doc_id").select("tokens", "script_tokens", F.round("script_share", 6).alias("script_share"))
