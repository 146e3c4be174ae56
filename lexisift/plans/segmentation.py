"""Queries of syllable segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions.scripts import METHODS
from lexisift.functions.text import held
from lexisift.functions.segment import compare_methods, joined, method_groups, segment, syllables
from lexisift.plans.registry import query
from lexisift.plans.sqltext import CORPUS, EACH, not_blank, tokens
from lexisift.sources.corpus import projected, table


@query(f"WITH {EACH} SELECT syllable, count(*) AS cnt FROM each GROUP BY syllable ORDER BY cnt DESC, syllable LIMIT 20")
def syllable_topk(spark, sf_dir):
    """The flagship query: the 20 most frequent syllables of the projected corpus."""
    d = projected(spark, sf_dir).select(F.explode(syllables("kt")).alias("syllable")).where(F.trim("syllable") != "")
    return d.groupBy("syllable").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "syllable").limit(20)


def _digest(method):
    def run(spark, sf_dir):
        d = held(projected(spark, sf_dir), "s", syllables("kt", method))
        return d.select("doc_id", F.size("s").cast("bigint").alias("syllable_count"), F.md5(F.array_join("s", "|")).alias("digest"))

    return run


for _name, _method in {"segment_regex": "regex_advanced", "segment_fast": "no_regex_fast", "segment_slow": "no_regex"}.items():
    query(f"WITH {CORPUS} SELECT doc_id, len(s)::BIGINT AS syllable_count, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {tokens(_method)} AS s FROM corpus)", _name)(_digest(_method))


@query(f"WITH {CORPUS}, m AS (SELECT doc_id, {tokens('regex_basic')} AS a, {tokens('regex_advanced')} AS b, {tokens('no_regex')} AS c, {tokens('no_regex_fast')} AS d FROM corpus) SELECT doc_id, len(a)::BIGINT AS regex_count, len(d)::BIGINT AS fast_count, a = b AND a = c AND a = d AS consistent FROM m")
def method_consistency(spark, sf_dir):
    d = compare_methods(projected(spark, sf_dir).select("doc_id", "kt"), "kt")
    return d.select("doc_id", F.size("regex_basic").cast("bigint").alias("regex_count"), F.size("no_regex_fast").cast("bigint").alias("fast_count"), "consistent")


@query(f"WITH {CORPUS}, m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS method, md5(array_to_string({tokens(m)}, '|')) AS digest FROM corpus" for m in METHODS) + ") SELECT doc_id, digest, array_to_string(list(method ORDER BY method), ',') AS methods FROM m GROUP BY ALL")
def method_hash_groups(spark, sf_dir):
    return method_groups(projected(spark, sf_dir), "doc_id", "kt").select("doc_id", "digest", F.array_join("methods", ",").alias("methods"))


@query(f"SELECT conv_id, turn, CASE WHEN {not_blank('text')} THEN len({tokens(text='text')}) ELSE 0 END::BIGINT AS syllables, text IS NOT NULL AS success FROM conversations")
def segment_batch(spark, sf_dir):
    d = segment(table(spark, sf_dir, "conversations"))
    return d.select("conv_id", "turn", F.col("syllable_count").cast("bigint").alias("syllables"), "success")


@query(f"WITH {CORPUS} SELECT doc_id, md5(array_to_string({tokens('no_regex_fast')}, '_')) AS joined FROM corpus")
def syllable_underscores(spark, sf_dir):
    return projected(spark, sf_dir).select("doc_id", F.md5(joined("kt", "no_regex_fast", "_")).alias("joined"))


@query(f"WITH {CORPUS} SELECT doc_id, array_to_string({tokens()}, '') = kt AS lossless FROM corpus")
def reconstruction(spark, sf_dir):
    """Whether the syllables of a text add up to it."""
    return projected(spark, sf_dir).select("doc_id", (joined("kt", separator="") == F.col("kt")).alias("lossless"))
