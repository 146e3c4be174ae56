"""Queries of vocabularies, encoding, windows and perplexities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions.scripts import SPACE_RE2
from lexisift.functions.segment import filled, syllables
from lexisift.functions.text import held
from lexisift.operators import vocab as V
from lexisift.plans.models import _SCORED, _model, char_scored
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, not_blank, tokens
from lexisift.plans.statistics import char_freq
from lexisift.sources.corpus import projected

_FAST = f"fast AS (SELECT doc_id, list_filter({tokens('no_regex_fast')}, lambda x: {not_blank('x')}) AS s FROM corpus), fs AS (SELECT doc_id, unnest(s) AS token, generate_subscripts(s, 1) - 1 AS pos FROM fast), fq AS (SELECT token, count(*) AS cnt FROM fs GROUP BY token), voc AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id, cnt FROM fq WHERE cnt >= 2 ORDER BY id LIMIT 2000)"


def _lists(spark, sf_dir):
    return projected(spark, sf_dir).select("doc_id", filled(syllables("kt", "no_regex_fast")).alias("s"))


def _freq(spark, sf_dir):
    return _lists(spark, sf_dir).select(F.explode("s").alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def _vocabulary(spark, sf_dir):
    return V.build(_freq(spark, sf_dir), most=2004)


@query(f"WITH {CORPUS}, f AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(kt, '[^{SPACE_RE2}]')) AS token FROM corpus) GROUP BY token) SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::INTEGER AS id, cnt FROM f WHERE cnt >= 2")
def char_vocab(spark, sf_dir):
    return V.build(char_freq(spark, sf_dir))


@query(f"WITH {CORPUS}, {_FAST} SELECT token, id, cnt FROM voc")
def syll_vocab(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query(f"WITH {CORPUS}, {_FAST} SELECT round(sum(cnt) FILTER (WHERE id IS NOT NULL) / sum(cnt), 6) AS occurrences, round(count(id) / count(*), 6) AS types FROM fq LEFT JOIN (SELECT token, id FROM voc) USING (token)")
def vocab_coverage(spark, sf_dir):
    return V.coverage(_freq(spark, sf_dir), _vocabulary(spark, sf_dir)).select(F.round("occurrences", 6).alias("occurrences"), F.round("types", 6).alias("types"))


@query(f"WITH {CORPUS}, {_FAST}, e AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM fs LEFT JOIN voc USING (token) WHERE pos < 64), l AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM e GROUP BY doc_id) SELECT d.doc_id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(0, 64 - len(coalesce(ids, []))), lambda x: 0)), ',') AS ids FROM documents d LEFT JOIN l USING (doc_id)")
def encode_ids(spark, sf_dir):
    out = V.encode(_lists(spark, sf_dir), "doc_id", "s", _vocabulary(spark, sf_dir), 64)
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {CORPUS}, {_FAST}, e AS (SELECT doc_id, pos, CASE WHEN id IS NULL THEN '<UNK>' ELSE token END AS t FROM fs LEFT JOIN (SELECT token, id FROM voc) USING (token) WHERE pos < 64), l AS (SELECT doc_id, string_agg(t, '' ORDER BY pos) AS text FROM e GROUP BY doc_id) SELECT doc_id, coalesce(text, '') AS text FROM documents d LEFT JOIN l USING (doc_id)".replace("coalesce(text", "coalesce(l.text"))
def encode_decode(spark, sf_dir):
    v = _vocabulary(spark, sf_dir)
    return V.decode(V.encode(_lists(spark, sf_dir), "doc_id", "s", v, 64), "doc_id", v)


@query(f"WITH {CORPUS}, {_FAST} SELECT doc_id, count(*) AS windows, md5(string_agg(substr(w, 1), '|' ORDER BY i)) AS digest FROM (SELECT doc_id, i, (SELECT string_agg(token, '' ORDER BY pos) FROM fs WHERE fs.doc_id = x.doc_id AND pos >= i AND pos < i + 50) AS w FROM (SELECT doc_id, unnest(range(0, len(s) - 50, 25)) AS i FROM fast) x) GROUP BY doc_id")
def train_windows(spark, sf_dir):
    lists = held(projected(spark, sf_dir), "s", filled(syllables("kt", "no_regex_fast")))
    w = held(lists.select("doc_id", "s"), "w", V.windows(F.col("s"), 50)).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("bigint").alias("windows"), F.md5(F.array_join(F.transform("w", lambda x: F.array_join(x, "")), "|")).alias("digest"))


_PERP = f"{CORPUS}, {_model('char', 3)}, {_SCORED}, pp AS (SELECT item_id, pos, 1 / greatest(p, 1e-10) AS x FROM scored)"


@query(f"WITH {_PERP} SELECT item_id, round(exp(avg(ln(x))), 5) AS perplexity FROM pp GROUP BY item_id")
def perplexity(spark, sf_dir):
    out = V.sequence_perplexity(V.perplexities(char_scored(spark, sf_dir), "item_id"), "item_id")
    return out.select("item_id", F.round("perplexity", 5).alias("perplexity"))


@query(f"WITH {_PERP}, q AS (SELECT item_id, count(*) AS n, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS u FROM pp GROUP BY item_id) SELECT item_id, pos::INTEGER AS pos, round(x, 5) AS perplexity FROM pp JOIN q USING (item_id) WHERE n >= 3 AND x > m + 2 * (u - m)")
def anomalies(spark, sf_dir):
    out = V.anomalies(V.perplexities(char_scored(spark, sf_dir), "item_id"), "item_id")
    return out.select("item_id", "pos", F.round("perplexity", 5).alias("perplexity"))


@query(f"WITH {_PERP}, s AS (SELECT item_id, exp(avg(ln(x))) AS p FROM pp GROUP BY item_id) SELECT count(*) AS texts, round(avg(p), 4) AS mean, round(median(p), 4) AS median, round(min(p), 4) AS least, round(max(p), 4) AS most, round(stddev_samp(p), 4) AS deviation, count(*) FILTER (WHERE p < 50) AS valid FROM s")
def perplexity_stats(spark, sf_dir):
    p = V.sequence_perplexity(V.perplexities(char_scored(spark, sf_dir), "item_id"), "item_id")
    r = lambda c, n: F.round(c, 4).alias(n)
    x = F.col("perplexity")
    return p.agg(F.count("*").alias("texts"), r(F.avg(x), "mean"), r(F.median(x), "median"), r(F.min(x), "least"), r(F.max(x), "most"), r(F.stddev_samp(x), "deviation"), F.count_if(x < 50).alias("valid"))

