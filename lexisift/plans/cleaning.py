"""Queries of cleaning, ratios, quality and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.scripts import SCRIPT, SPACE_RE2
from lexisift.functions.segment import syllables
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, count, ratio, strip, tokens
from lexisift.sources.corpus import projected, table

_S = SPACE_RE2


def _chain(x: str, steps) -> str:
    for p, to in steps:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


_MARKUP = [(r"<[^>]+>", ""), (r"&[a-zA-Z]+;", ""), (r"&#\p{Nd}+;", ""), (r"javascript:[^\n]*?;", ""), (rf"mailto:[^\n]*?[{_S}>]", "")]
_UNWANTED = [(r"\[[^\n]*?\]", ""), (r"\([^\n]*?\)", ""), (r"https?://[!$-_a-z]+", ""), (rf"[^{_S}]+@[^{_S}]+\.[^{_S}]+", ""), (rf"\+?[\p{{Nd}}{_S}\-()]{{10,}}", ""), (r"[.]{3,}", "..."), (r"!{2,}", "!"), (r"\?{2,}", "?")]


def markup_sql(x: str) -> str:
    return strip(_chain(f"coalesce({x}, '')", _MARKUP))


def clean_sql(x: str) -> str:
    x = f"translate(nfc_normalize({markup_sql(x)}), chr(160) || chr(8203) || chr(65279), ' ')"
    return strip(_chain(strip(_chain(x, _UNWANTED)), [(rf"[{_S}]+", " ")]))


def quality_sql(x: str, least_ratio: float = 0.6, least_length: int = 50) -> str:
    """Columns of the metrics of x; the score is quality_score."""
    n, r, w = f"length({x})", ratio(x), count(x, rf"[^{_S}]+")
    s = f"CASE WHEN {n} = 0 THEN 0 ELSE greatest({count(x, '[.!?]+')}, 1) END"
    mean = f"({count(x, rf'[^{_S}]')} / greatest({w}, 1))"
    enc = f"({n} > 0 AND NOT regexp_matches({x}, '\\x{{FFFD}}|[{SCRIPT}]{{20}}'))"
    return f"""CAST({n} AS BIGINT) AS length, CAST({w} AS BIGINT) AS word_count, CAST({s} AS BIGINT) AS sentence_count, {r} AS khmer_ratio, {mean} AS avg_word_length, {enc} AS has_proper_encoding,
least(1.0, CASE WHEN {r} >= {least_ratio} THEN 0.3 * least({r} / 0.8, 1.0) ELSE 0 END + CASE WHEN {n} >= {least_length} THEN 0.2 * least({n} / 500, 1.0) ELSE 0 END
 + CASE WHEN {w} > 0 THEN 0.2 * least({w} / greatest({n}, 1) * 10, 1.0) ELSE 0 END + CASE WHEN {n} > 0 AND {w} / greatest({s}, 1) BETWEEN 5 AND 25 THEN 0.15 ELSE 0 END
 + CASE WHEN {mean} BETWEEN 3 AND 15 THEN 0.1 ELSE 0 END + CASE WHEN {enc} THEN 0.05 ELSE 0 END) AS quality_score"""


@query(f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text("text").alias("cleaned"))


@query(f"SELECT page_id, {markup_sql('html')} AS cleaned FROM pages")
def clean_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup("html").alias("cleaned"))


@query(f"SELECT doc_id, {strip(_chain('text', [(f'[{_S}]+', ' '), (chr(92) + '[[^' + chr(92) + 'n]*?' + chr(92) + ']', ''), (chr(92) + '([^' + chr(92) + 'n]*?' + chr(92) + ')', '')]))} AS cleaned FROM documents")
def clean_scraped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_scraped("text").alias("cleaned"))


@query(f"WITH {CORPUS}, m AS (SELECT doc_id, {quality_sql('kt')} FROM corpus) SELECT doc_id, length, word_count, sentence_count, round(khmer_ratio, 6) AS khmer_ratio, round(avg_word_length, 6) AS avg_word_length, has_proper_encoding, round(quality_score, 6) AS quality_score FROM m")
def quality_metrics(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    d = T.with_quality(projected(spark, sf_dir), "kt")
    return d.select("doc_id", "length", "word_count", "sentence_count", r("khmer_ratio"), r("avg_word_length"), "has_proper_encoding", r("quality_score"))


_PIPE = f"""{CORPUS}, cleaned AS (SELECT doc_id, lang, source, {clean_sql('kt')} AS c FROM corpus), m AS (SELECT doc_id, lang, source, c, {quality_sql('c', 0.7, 20)} FROM cleaned),
v AS (SELECT *, length >= 20 AND khmer_ratio >= 0.7 AND quality_score >= 0.6 AS is_valid, CASE WHEN length >= 20 AND khmer_ratio >= 0.7 AND quality_score >= 0.6 THEN len({tokens('regex_basic', 'c')}) ELSE 0 END AS syllable_count FROM m)"""


def pipeline_rows(spark, sf_dir):
    """Cleaned texts with their metrics, validity and (if valid) syllables."""
    d = T.held(projected(spark, sf_dir), "c", T.clean_text("kt")).select("doc_id", "lang", "source", "c")
    d = T.with_quality(d, "c", 0.7, 20)
    d = d.withColumn("is_valid", (F.col("length") >= 20) & (F.col("khmer_ratio") >= 0.7) & (F.col("quality_score") >= 0.6))
    empty = F.array().cast("array<string>")
    return d.withColumn("syllables", F.when(F.col("is_valid"), syllables("c", "regex_basic")).otherwise(empty)).withColumn("syllable_count", F.size("syllables").cast("bigint"))


@query(f"WITH {_PIPE} SELECT doc_id, is_valid, syllable_count, word_count, length AS character_count, round(quality_score, 6) AS quality_score FROM v")
def pipeline_valid(spark, sf_dir):
    return pipeline_rows(spark, sf_dir).select("doc_id", "is_valid", "syllable_count", "word_count", F.col("length").alias("character_count"), F.round("quality_score", 6).alias("quality_score"))


@query(f"""WITH {_PIPE} SELECT source, count(*) AS texts, count(*) FILTER (WHERE is_valid) AS valid_texts, round(count(*) FILTER (WHERE is_valid) / count(*), 6) AS acceptance_rate,
coalesce(sum(syllable_count), 0)::BIGINT AS syllables, round(avg(khmer_ratio) FILTER (WHERE is_valid), 6) AS mean_ratio, round(avg(quality_score) FILTER (WHERE is_valid), 6) AS mean_score FROM v GROUP BY ROLLUP (source)""")
def processing_summary(spark, sf_dir):
    """One row for each source and one (null) for all; means are over valid texts alone."""
    valid = F.col("is_valid")
    return (
        pipeline_rows(spark, sf_dir)
        .rollup("source")
        .agg(
            F.count("*").alias("texts"),
            F.count_if(valid).alias("valid_texts"),
            F.round(F.count_if(valid) / F.count("*"), 6).alias("acceptance_rate"),
            F.sum("syllable_count").alias("syllables"),
            F.round(F.avg(F.when(valid, F.col("khmer_ratio"))), 6).alias("mean_ratio"),
            F.round(F.avg(F.when(valid, F.col("quality_score"))), 6).alias("mean_score"),
        )
    )


_LATIN = f"coalesce({count('c', '[A-Za-z]')} / nullif({count('c', chr(92) + 'p{L}')}, 0), 0.0)"


@query(f"""WITH {CORPUS}, cleaned AS (SELECT doc_id, {clean_sql('kt')} AS c FROM corpus), m AS (SELECT doc_id, c, {quality_sql('c')} FROM cleaned)
SELECT CASE WHEN length < 50 THEN 'length' WHEN khmer_ratio < 0.6 THEN 'khmer_ratio' WHEN NOT has_proper_encoding THEN 'encoding' WHEN {_LATIN} > 0.3 THEN 'khmer_ratio' WHEN quality_score < 0.5 THEN 'quality' ELSE 'accepted' END AS reason, count(*) AS texts FROM m GROUP BY 1""")
def accept_reasons(spark, sf_dir):
    d = T.with_quality(T.held(projected(spark, sf_dir), "c", T.clean_text("kt")), "c")
    return d.groupBy(F.coalesce(T.reject_reason(), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("texts"))


@query(f"WITH {CORPUS} SELECT source, count(*) AS texts, count(*) FILTER (WHERE {ratio('kt')} >= 0.6) AS in_script, sum(length(kt))::BIGINT AS chars, count(*) FILTER (WHERE {ratio('kt')} >= 0.6 AND length(kt) >= 50) AS fit FROM corpus GROUP BY source")
def source_rollup(spark, sf_dir):
    fit = T.script_ratio("kt") >= 0.6
    return projected(spark, sf_dir).groupBy("source").agg(F.count("*").alias("texts"), F.count_if(fit).alias("in_script"), F.sum(F.length("kt")).cast("bigint").alias("chars"), F.count_if(fit & (F.length("kt") >= 50)).alias("fit"))


@query(f"WITH {CORPUS} SELECT doc_id, md5(CASE WHEN coalesce({count('kt', f'[{SCRIPT}]')} / nullif({count('kt', f'[^{_S}]')}, 0), -1.0) < 0.0 THEN '' ELSE regexp_replace(kt, '[^{SCRIPT}{_S}]', '', 'g') END) AS filtered FROM corpus")
def model_text(spark, sf_dir):
    return projected(spark, sf_dir).select("doc_id", F.md5(T.model_text("kt")).alias("filtered"))


@query(f"SELECT doc_id, pos::BIGINT AS pos, p AS paragraph FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS a FROM documents)) t, LATERAL (SELECT {strip('x')} AS p) WHERE length(p) >= 50")
def paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("\n\n")), "\n\n")).alias("pos", "x"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.strip("x").alias("paragraph")).where(F.length("paragraph") >= 50)


@query(f"SELECT doc_id, pos::BIGINT AS pos, p AS sentence FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\\x{{17D4}}]+') AS a FROM documents)) t, LATERAL (SELECT {strip('x')} AS p) WHERE length(p) > 10")
def sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?\x{17D4}]+")).alias("pos", "x"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.strip("x").alias("sentence")).where(F.length("sentence") > 10)


@query("""SELECT doc_id, count(*) AS pieces, max(length(p))::BIGINT AS longest FROM (SELECT doc_id, unnest(CASE WHEN length(x) > 300 THEN string_split(x, chr(10)) ELSE [x] END) AS p FROM
(SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS x FROM documents)) WHERE length(trim(p)) >= 3 GROUP BY doc_id""")
def refined_paragraphs(spark, sf_dir):
    refined = F.flatten(F.transform(F.split("text", "\n\n"), lambda p: F.when(F.length(p) > 300, F.split(p, "\n")).otherwise(F.array(p))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(refined).alias("p")).where(F.length(F.trim("p")) >= 3)
    return d.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max(F.length("p")).cast("bigint").alias("longest"))


@query("SELECT doc_id, pos::BIGINT AS pos, substr(text, pos * 1000 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 999) // 1000))) AS pos FROM documents)")
def char_chunks(spark, sf_dir):
    """Chunks of 1000 characters, in order."""
    last = F.greatest(F.lit(0), F.floor((F.length("text") + 999) / 1000).cast("int") - 1)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.expr("substr(text, pos * 1000 + 1, 1000)").alias("chunk"))


@query("SELECT q.quality, count(*) AS texts, round(avg(d.n_chars), 4) AS mean_chars FROM documents d LEFT JOIN labels q USING (doc_id) GROUP BY q.quality")
def label_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("quality").agg(F.count("*").alias("texts"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
