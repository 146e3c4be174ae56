"""Boilerplate lines that spread over many sites, by distinct-count sketches; DataFrame functions only.

One aggregation merges a HyperLogLog sketch of the sites of each line hash. Estimates well above the threshold decide
at once, estimates well below too; lines near it get an exact distinct count. Such lines then go from every document
but the first one that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import fresh, stored


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_words(line: Column) -> Column:
    return F.size(F.split(F.trim(line), r"[\x20\x09-\x0D]+"))


def most_words(text: Column) -> Column:
    """A bound on the words of a text: the characters between words, and one."""
    return F.length(text) - F.length(F.translate(text, " \t\n\x0b\f\r", "")) + 1


def most_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", "")) + 1


def own_lines(text: Column) -> Column:
    """The distinct lines of a text that are not blank."""
    return F.filter(F.array_distinct(F.split(text, "\n")), lambda x: F.trim(x) != "")


def spread_lines(docs: DataFrame, sites: int, site: str = "source", lg_k: int = 12, margin: float = 0.3, sizes: bool = False) -> DataFrame:
    """(h, first) for each line hash on at least ``sites`` distinct sites; ``margin`` bounds what counts as near.

    Blank lines and null sites do not count. first.doc_id is the smallest doc_id with the line; with ``sizes``,
    first.words and first.lines are bounds on that document's words and lines.
    """
    own = [most_words(F.col("text")).alias("words"), most_lines(F.col("text")).alias("lines")] if sizes else []
    # What belongs to a document is worked out below the explosion, once, and the text does not go through it.
    each = docs.select(F.col(site).alias("site"), F.struct("doc_id", *own).alias("doc"), F.split("text", "\n").alias("lines"))
    lines = each.select("site", "doc", F.explode("lines").alias("line")).where(F.trim("line") != "").select("site", "doc", line_hash(F.col("line")).alias("h"))
    known = F.when(F.col("doc.doc_id").isNotNull(), F.col("doc"))
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("site").alias("n"), F.min(known).alias("first")).where(F.col("n") >= sites)
    spread = spread.select("h", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - margin))
    spread = stored(spread, "spread")
    near = spread.where(F.col("estimate") <= sites * (1 + margin)).select("h", "first")
    exact = lines.join(near.select("h"), "h", "left_semi").where("site is not null").select("h", "site").distinct().groupBy("h").count().where(F.col("count") >= sites).select("h")
    return spread.where(F.col("estimate") > sites * (1 + margin)).select("h", "first").union(near.join(exact, "h").select("h", "first"))


def drop_spread_lines(docs: DataFrame, sites: int = 5, site: str = "source", spare_copies: bool = False, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the lines found on ``sites`` sites or more; n_lines and n_removed are added.

    A line counts trimmed of spaces; blank lines stay. The first document with a line (the smallest doc_id) keeps it,
    so no line is lost from the corpus. Null text stays null with no lines. Rows that repeat a doc_id are treated
    alike; rows without doc_id lose spread lines unless no row with doc_id has them. An empty table gives an empty
    table. Columns named n_lines or n_removed are replaced; other columns, of any name, pass through.

    spare_copies: a document stays whole if the spread lines it shares with one earlier document prove, in the same
    order, that both have ``percent`` of their runs of ``shingle`` words in common: it is a copy, which
    near-duplicate search is to find. Each line that only one of them has costs at most ``shingle`` - 1 runs on top
    of its own words.
    """
    docs = docs.drop("n_lines", "n_removed")
    doc, cut_hashes, common, text_left, lines_left = fresh(docs.columns, "hit_doc", "cut_hashes", "common", "text_left", "lines_left")
    spread = stored(spread_lines(docs, sites, site, sizes=spare_copies), "boilerplate")
    lines = docs.select(F.col("doc_id").alias(doc), F.explode(own_lines(F.col("text"))).alias("line"))
    lines = lines.select(doc, line_hash(F.col("line")).alias("h"), *([line_words(F.col("line")).alias("words")] if spare_copies else []))
    hits = lines.join(spread, "h").where(~F.col(doc).eqNullSafe(F.col("first.doc_id")))
    if spare_copies:
        by_first = hits.groupBy(doc, "first").agg(F.collect_set(F.struct("h", "words")).alias("own"))
        shared = F.struct(F.aggregate("own", F.lit(0), lambda n, x: n + x["words"]).alias("words"), F.size("own").alias("lines"), F.col("first.words").alias("first_words"), F.col("first.lines").alias("first_lines"))
        by_first = by_first.select(doc, F.col("own.h").alias("h"), shared.alias("shared"))
        hits = by_first.groupBy(doc).agg(F.flatten(F.collect_list("h")).alias(cut_hashes), F.max("shared").alias(common))
    else:
        hits = hits.groupBy(doc).agg(F.collect_set("h").alias(cut_hashes))
    hits = stored(hits, "hits")
    # As many documents as lines are hit, so this side grows with the input: never a broadcast.
    joined = docs.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    split = F.split("text", "\n")
    left = F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(cut_hashes, line_hash(x)))
    out = joined.withColumn(text_left, F.array_join(left, "\n")).withColumn(lines_left, F.size(left))
    cut = F.col(cut_hashes).isNotNull()
    if spare_copies:
        c = lambda k: F.col(f"{common}.{k}")
        gap = shingle - 1
        runs = c("words") - gap * (most_lines(F.col("text")) + c("first_lines") - 2 * c("lines") + 1)
        cut &= ~F.coalesce((100 + percent) * runs >= percent * (most_words(F.col("text")) + c("first_words") - 2 * gap), F.lit(False))
    count = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c).cast("bigint")
    return out.select(
        *(F.when(cut, F.col(text_left)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        count(F.size(split)).alias("n_lines"),
        count(F.when(cut, F.size(split) - F.col(lines_left)).otherwise(0)).alias("n_removed"),
    )


#: The same rows by counting sites exactly.
SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, * FROM documents),
lines AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
spread AS (SELECT trim(line) AS h, min(doc_id) AS first_doc FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
marked AS (SELECT l.*, s.h IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first_doc AS cut FROM lines l LEFT JOIN spread s ON trim(l.line) = s.h),
texts AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS text, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed FROM marked GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, d.lang, d.source, d.n_chars, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM rows d LEFT JOIN texts t USING (r)
"""
