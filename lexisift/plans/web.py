"""Queries of web pages, requests and parameter search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.udfs import article
from lexisift.operators import search as P
from lexisift.plans.registry import query
from lexisift.sources.corpus import table


@query("SELECT page_id, pos::BIGINT AS pos, url FROM (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS u FROM pages)) WHERE starts_with(url, '/') OR contains(url, '://')")
def page_links(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "url"))
    return d.select("page_id", F.col("pos").cast("bigint").alias("pos"), "url").where(F.startswith("url", F.lit("/")) | F.contains("url", F.lit("://")))


@query("SELECT url AS link, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS url FROM pages) GROUP BY url")
def link_counts(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    return d.groupBy("link").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), ''), regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def page_titles(spark, sf_dir):
    d = table(spark, sf_dir, "pages")
    title = F.coalesce(F.nullif(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), F.lit("")), F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return d.select("page_id", title.alias("title"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))


@query()
def page_text(spark, sf_dir):
    """Title and article text by an HTML parser; tested on fixtures, as SQL has no parser."""
    d = table(spark, sf_dir, "pages").select("page_id", article("html").alias("a"))
    return d.select("page_id", "a.title", T.clean_scraped("a.content").alias("content"), "a.date")


@query("SELECT user_id, count(*) AS requests, count(DISTINCT event_type) AS kinds, round(avg(value), 4) AS mean_value FROM events GROUP BY user_id")
def request_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_distinct("event_type").alias("kinds"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, length(text)::BIGINT AS n FROM conversations")
def turn_context(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev_role"), F.length("text").cast("bigint").alias("n"))


_GRID = ", ".join(f"(SELECT unnest([{', '.join(str(low + (high - low) * i / 4) for i in range(5))}])::DOUBLE AS {k})" for k, (low, high) in P.SPACE.items())


@query(f"SELECT round(neural_weight / (neural_weight + statistical_weight + rule_weight), 9) AS neural_weight, round(statistical_weight / (neural_weight + statistical_weight + rule_weight), 9) AS statistical_weight, round(rule_weight / (neural_weight + statistical_weight + rule_weight), 9) AS rule_weight, round(error_threshold, 6) AS error_threshold, round(consensus_threshold, 6) AS consensus_threshold FROM {_GRID}")
def param_grid(spark, sf_dir):
    digits = lambda k: 9 if k.endswith("weight") else 6
    return P.grid(spark).select(*(F.round(k, digits(k)).alias(k) for k in P.SPACE))
