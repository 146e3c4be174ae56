"""Queries of n-gram models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions.scripts import LATIN, PROJECTED, SCRIPT, SPACE_RE2
from lexisift.operators import counting as C
from lexisift.operators import ngrams as N
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, not_blank, tokens
from lexisift.sources.corpus import projected, table
from lexisift.sources.shared import stored

_S = SPACE_RE2
_KEEP = f"CASE WHEN coalesce(len(regexp_extract_all(kt, '[{SCRIPT}]')) / nullif(len(regexp_extract_all(kt, '[^{_S}]')), 0), -1.0) < 0.0 THEN '' ELSE regexp_replace(kt, '[^{SCRIPT}{_S}]', '', 'g') END"
_BENCH = f"bench AS (SELECT item_id, translate(lower(text), '{LATIN}', '{PROJECTED}') AS kt FROM benchmark)"


def _padded(kind: str, n: int, source: str, key: str) -> str:
    """Rows (key, a): padded units of each text that has any."""
    if kind == "char":
        pad = "[" + ", ".join(["'<'"] * (n - 1)) + "]"
        return f"SELECT {key}, list_concat(list_concat({pad}, regexp_extract_all(k, '(?s).')), {pad}) AS a FROM (SELECT {key}, {_KEEP} AS k FROM {source}) WHERE k <> ''"
    first, last = ("[" + ", ".join([f"'{x}'"] * (n - 1)) + "]" for x in ("<START>", "<END>"))
    fit = f"list_filter({tokens()}, lambda x: {not_blank('x')} AND length(x) BETWEEN 1 AND 10 AND len(regexp_extract_all(x, '[{SCRIPT}]')) >= 0.5 * len(regexp_extract_all(x, '[^{_S}]')))"
    return f"SELECT {key}, list_concat(list_concat({first}, s), {last}) AS a FROM (SELECT {key}, {fit} AS s FROM {source}) WHERE len(s) >= {n}"


def _grams(name: str, units: str, key: str, n: int, sep: str) -> str:
    """CTE of (key, pos, ngram, context)."""
    run = lambda m: "t" + "".join(f" || '{sep}' || lead(t, {k}) OVER w" for k in range(1, m))
    return f"{name}_e AS (SELECT {key}, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS pos FROM ({units})), {name} AS (SELECT {key}, pos, {run(n)} AS ngram, {run(n - 1)} AS context FROM {name}_e WINDOW w AS (PARTITION BY {key} ORDER BY pos))"


def _model(kind: str, n: int) -> str:
    sep = "" if kind == "char" else " | "
    pads = "" if kind == "char" else "WHERE t NOT IN ('<START>', '<END>')"
    return f"""{_grams('g', _padded(kind, n, 'corpus', 'doc_id'), 'doc_id', n, sep)},
ng AS (SELECT ngram, any_value(context) AS context, count(*) AS cnt FROM g WHERE ngram IS NOT NULL GROUP BY ngram), cx AS (SELECT context, count(*) AS ccnt FROM g WHERE context IS NOT NULL GROUP BY context),
sizes AS (SELECT (SELECT count(DISTINCT t) FROM g_e {pads}) AS v, (SELECT sum(cnt) FROM ng)::BIGINT AS total)"""


_SCORED = f"""{_BENCH}, {_grams('h', _padded('char', 3, 'bench', 'item_id'), 'item_id', 3, '')},
scored AS (SELECT item_id, pos, h.ngram, CASE WHEN coalesce(ccnt, 0) > 0 THEN (coalesce(cnt, 0) + 1.0) / (ccnt + v) ELSE 1.0 / (total + v) END AS p
FROM h LEFT JOIN ng USING (ngram) LEFT JOIN cx ON cx.context = h.context, sizes WHERE h.ngram IS NOT NULL)"""
_SYLL_SCORED = f"""{_BENCH}, {_grams('h', _padded('syllable', 2, 'bench', 'item_id'), 'item_id', 2, ' | ')},
scored AS (SELECT item_id, pos, h.ngram, CASE WHEN coalesce(ccnt, 0) > 0 THEN (coalesce(cnt, 0) + 1.0) / (ccnt + v) ELSE 1.0 / (total + v) END AS p
FROM h LEFT JOIN ng USING (ngram) LEFT JOIN cx ON cx.context = h.context, sizes WHERE h.ngram IS NOT NULL)"""


def model_counts(spark, sf_dir):
    """The n-grams of all six models of the corpus, counted in one reading and written once."""
    return stored(C.counted(projected(spark, sf_dir), "kt", _ALL), "ngrams")


def one_of(counts, kind: str, n: int) -> N.Model:
    """A model of those that ``model_counts`` has."""
    own = counts.where(F.col("model") == _ALL.index((kind, n))).select("ngram", "cnt")
    return N.train(None, "u", n, "", counts=own) if kind == "char" else N.train(None, "u", n, " | ", (N.START, N.END), counts=own)


def char_model(spark, sf_dir, n: int = 3) -> N.Model:
    units = projected(spark, sf_dir).select(N.char_units("kt", n).alias("u"))
    return N.train(units, "u", n, "")


def syllable_model(spark, sf_dir, n: int = 2) -> N.Model:
    units = projected(spark, sf_dir).select(N.syllable_units("kt", n).alias("u"))
    return N.train(units, "u", n, " | ", (N.START, N.END))


def bench_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate(F.lower("text"), LATIN, PROJECTED).alias("kt"))


def char_scored(spark, sf_dir, model: N.Model | None = None):
    return N.scored(bench_texts(spark, sf_dir), "item_id", N.char_units("kt", 3), model or char_model(spark, sf_dir))


@query(f"WITH {CORPUS}, {_model('char', 3)} SELECT ngram, cnt FROM ng")
def char_ngrams(spark, sf_dir):
    return char_model(spark, sf_dir).ngrams.select("ngram", "cnt")


@query(f"WITH {CORPUS}, {_model('char', 3)} SELECT context, ccnt AS cnt FROM cx")
def char_contexts(spark, sf_dir):
    return char_model(spark, sf_dir).contexts


@query(f"WITH {CORPUS}, {_model('syllable', 2)} SELECT ngram, cnt FROM ng")
def syll_ngrams(spark, sf_dir):
    return syllable_model(spark, sf_dir).ngrams.select("ngram", "cnt")


_STATS = "SELECT '{kind}' AS kind, {n} AS n, v AS vocabulary, total, (SELECT count(*) FROM ng) AS unique_ngrams, round((SELECT count(*) FROM ng) / pow(v, {n}), 9) AS coverage, round((SELECT log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) FROM ng), 6) AS entropy FROM sizes"
_ALL = [("char", 3), ("char", 4), ("char", 5), ("syllable", 2), ("syllable", 3), ("syllable", 4)]


@query(" UNION ALL ".join(f"(WITH {CORPUS}, {_model(k, n)} {_STATS.format(kind=k, n=n)})" for k, n in _ALL))
def model_stats(spark, sf_dir):
    out = None
    for kind, n in _ALL:
        m = char_model(spark, sf_dir, n) if kind == "char" else syllable_model(spark, sf_dir, n)
        one = N.statistics(m).select(F.lit(kind).alias("kind"), "n", "vocabulary", "total", "unique_ngrams", F.round("coverage", 9).alias("coverage"), F.round("entropy", 6).alias("entropy"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {CORPUS}, {_model('char', 3)} SELECT ngram, round((cnt + 1.0) / (ccnt + v), 9) AS probability FROM ng JOIN cx USING (context), sizes")
def laplace_prob(spark, sf_dir):
    return N.probabilities(char_model(spark, sf_dir)).select("ngram", F.round("probability", 9).alias("probability"))


@query(f"WITH {CORPUS}, {_model('char', 3)} SELECT ngram, round(cnt / ccnt, 9) AS probability FROM ng JOIN cx USING (context)")
def backoff_prob(spark, sf_dir):
    return N.probabilities(char_model(spark, sf_dir), "simple_backoff").select("ngram", F.round("probability", 9).alias("probability"))


_GT = "ff AS (SELECT cnt, count(*) AS types FROM ng GROUP BY cnt), gt AS (SELECT a.cnt, a.types, CASE WHEN b.types IS NOT NULL THEN greatest((a.cnt + 1) * b.types / a.types, a.cnt * 0.1) ELSE a.cnt END AS adjusted FROM ff a LEFT JOIN ff b ON b.cnt = a.cnt + 1)"


@query(f"WITH {CORPUS}, {_model('char', 3)}, {_GT} SELECT cnt, types, round(adjusted, 6) AS adjusted FROM gt")
def good_turing_adjusted(spark, sf_dir):
    return N.good_turing(char_model(spark, sf_dir).ngrams).select("cnt", "types", F.round("adjusted", 6).alias("adjusted"))


@query(f"WITH {CORPUS}, {_model('char', 3)}, {_GT} SELECT ngram, round(adjusted / ccnt, 9) AS probability FROM ng JOIN cx USING (context) JOIN gt USING (cnt)")
def good_turing_prob(spark, sf_dir):
    return N.probabilities(char_model(spark, sf_dir), "good_turing").select("ngram", F.round("probability", 9).alias("probability"))


@query(f"""WITH {CORPUS}, {_model('char', 3)}, o AS (SELECT count(*) FILTER (WHERE cnt = 1) AS once FROM ng)
SELECT 'laplace' AS method, v AS vocabulary_size, total AS total_ngrams, round(1.0 / (total + v), 12) AS unseen_probability, round(total / (total + v), 9) AS coverage FROM sizes
UNION ALL SELECT 'good_turing', v, total, round(once / total, 12), round(1 - once / total, 9) FROM sizes, o UNION ALL SELECT 'simple_backoff', v, total, round(0.4 / v, 12), 0.6 FROM sizes""")
def smoothing_compare(spark, sf_dir):
    return N.smoothing_statistics(char_model(spark, sf_dir)).select("method", "vocabulary_size", "total_ngrams", F.round("unseen_probability", 12).alias("unseen_probability"), F.round("coverage", 9).alias("coverage"))


@query(f"WITH {CORPUS}, {_model('char', 3)}, {_SCORED} SELECT item_id, round(avg(ln(p)), 6) AS log_probability, count(*) AS n_ngrams FROM scored GROUP BY item_id")
def text_logprob(spark, sf_dir):
    out = N.text_scores(bench_texts(spark, sf_dir), "item_id", char_scored(spark, sf_dir), "kt")
    return out.withColumn("log_probability", F.round("log_probability", 6))


@query(f"WITH {CORPUS}, {_model('char', 3)}, {_SCORED}, m AS (SELECT item_id, avg(ln(p)) AS l FROM scored GROUP BY 1) SELECT count(*) AS texts, round(avg(l), 6) AS mean_log_probability, round(exp(-avg(l)), 4) AS perplexity FROM m")
def heldout_eval(spark, sf_dir):
    out = N.text_scores(bench_texts(spark, sf_dir), "item_id", char_scored(spark, sf_dir), "kt")
    m = F.avg("log_probability")
    return out.agg(F.count("*").alias("texts"), F.round(m, 6).alias("mean_log_probability"), F.round(F.exp(-m), 4).alias("perplexity"))


@query(f"WITH {CORPUS}, {_model('char', 3)}, {_SCORED} SELECT item_id, pos::BIGINT AS pos, greatest(0, pos - 2)::BIGINT AS start, least(length(kt), greatest(0, pos - 2) + 3)::BIGINT AS \"end\", ngram, round(1 - p / 0.001, 6) AS confidence FROM scored JOIN bench USING (item_id) WHERE p < 0.001")
def char_errors(spark, sf_dir):
    out = N.char_errors(char_scored(spark, sf_dir), bench_texts(spark, sf_dir), "item_id", "kt", 3)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return out.select("item_id", big("pos"), big("start"), big("end"), "ngram", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {CORPUS}, {_model('char', 3)}, {_SCORED} SELECT item_id, count(*) AS n_ngrams, count(*) FILTER (WHERE p < 0.001) AS n_errors, round(1 - count(*) FILTER (WHERE p < 0.001) / count(*), 6) AS overall_score, round(avg(p), 9) AS average_probability, round(min(p), 9) AS min_probability FROM scored GROUP BY item_id")
def char_error_scores(spark, sf_dir):
    out = N.error_summary(char_scored(spark, sf_dir), "item_id")
    return out.select("item_id", "n_ngrams", "n_errors", F.round("overall_score", 6).alias("overall_score"), F.round("average_probability", 9).alias("average_probability"), F.round("min_probability", 9).alias("min_probability"))


def syllable_scored(spark, sf_dir):
    return N.scored(bench_texts(spark, sf_dir), "item_id", N.syllable_units("kt", 2), syllable_model(spark, sf_dir))


@query(f"""WITH {CORPUS}, {_model('syllable', 2)}, {_SYLL_SCORED}, st AS (SELECT item_id, t AS syllable, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS at, sum(length(t)) OVER (PARTITION BY item_id ORDER BY pos) - length(t) AS start, count(*) OVER (PARTITION BY item_id) AS n FROM h_e WHERE t NOT IN ('<START>', '<END>')),
voc AS (SELECT DISTINCT t FROM g_e WHERE t NOT IN ('<START>', '<END>'))
SELECT s.item_id, s.pos::BIGINT AS pos, st.start::BIGINT AS start, (st.start + length(st.syllable))::BIGINT AS "end", st.syllable, round(1 - p / 0.001, 6) AS confidence, CASE WHEN voc.t IS NULL THEN 'suspicious' ELSE 'invalid_sequence' END AS kind
FROM scored s JOIN st ON st.item_id = s.item_id AND st.at = least(s.pos + 1, st.n - 1) LEFT JOIN voc ON voc.t = st.syllable WHERE p < 0.001""")
def syll_errors(spark, sf_dir):
    m = projected(spark, sf_dir).select(F.explode(N.syllable_units("kt", 2)).alias("token")).distinct().where(~F.col("token").isin(N.START, N.END))
    out = N.syllable_errors(bench_texts(spark, sf_dir), "item_id", "kt", syllable_scored(spark, sf_dir), m, 2)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return out.select("item_id", big("pos"), big("start"), big("end"), "syllable", F.round("confidence", 6).alias("confidence"), "kind")


@query(f"""WITH {CORPUS} SELECT least_ratio, count(*) FILTER (WHERE r >= least_ratio) AS texts_kept, (sum(n) FILTER (WHERE r >= least_ratio))::BIGINT AS script_chars, round(sum(n) FILTER (WHERE r >= least_ratio) / sum(length(kt)), 6) AS retention
FROM (SELECT kt, len(regexp_extract_all(kt, '[{SCRIPT}]')) AS n, coalesce(len(regexp_extract_all(kt, '[{SCRIPT}]')) / nullif(len(regexp_extract_all(kt, '[^{_S}]')), 0), -1.0) AS r FROM corpus), (SELECT unnest([0.1, 0.3, 0.5, 0.8, 0.95])::DOUBLE AS least_ratio) GROUP BY least_ratio""")
def filter_configs(spark, sf_dir):
    """What each least share of script characters keeps."""
    d = projected(spark, sf_dir).select("kt", F.regexp_count("kt", F.lit(f"[{SCRIPT}]")).alias("n"), F.regexp_count("kt", F.lit(rf"[^\s\x1c-\x1f\x85\p{{Z}}]")).alias("m"))
    d = d.withColumn("r", F.coalesce(F.col("n") / F.nullif("m", F.lit(0)), F.lit(-1.0))).select("*", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.8, 0.95)))).alias("least_ratio"))
    kept = F.col("r") >= F.col("least_ratio")
    return d.groupBy("least_ratio").agg(F.count_if(kept).alias("texts_kept"), F.sum(F.when(kept, F.col("n"))).cast("bigint").alias("script_chars"), F.round(F.sum(F.when(kept, F.col("n"))) / F.sum(F.length("kt")), 6).alias("retention"))
