"""News sites: which links of a page are articles, and which pages make an article of the corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.udfs import article


@dataclass(frozen=True)
class Site:
    """A site's name, its base address, its listing pages, the rule of its article links and what a relative link is put behind."""

    name: str
    base: str
    sections: tuple[str, ...]
    wanted: Callable[[Column], Column]
    prefix: str = ""
    pages: int = 1
    paged: str = ""

    def listings(self, pages: int | None = None) -> list[str]:
        """The addresses of the listing pages."""
        if not self.paged:
            return [self.base + s for s in self.sections]
        return [self.base + s + self.paged.format(k) for s in self.sections for k in range(1, (pages or self.pages) + 1)]


# The sites' addresses, sections and link rules.
SITES = {
    "voa": Site("VOA_Khmer", "https://www.voakhmernews.com", ("/section/cambodia", "/section/world", "/section/politics", "/section/society"), lambda u: F.contains(u, F.lit("/a/")), "https://www.voakhmernews.com", 10, "?page={}"),
    "khmertimes": Site("Khmer_Times", "https://www.khmertimeskh.com", ("/category/%e1%9e%80%e1%9e%98%e1%9f%92%e1%9e%96%e1%9e%bb%e1%9e%87%e1%9e%b6", "/category/news", "/category/politics"), lambda u: u.rlike(r"/[0-9]{4}/[0-9]{2}/[0-9]{2}/"), "", 10, "/page/{}"),
    "rfa": Site("RFA_Khmer", "https://www.rfa.org/khmer", ("/news", "/politics", "/society", "/business"), lambda u: F.startswith(u, F.lit("/khmer/")) & F.contains(u, F.lit("/news/")), "https://www.rfa.org"),
}


def site(key: str) -> Site:
    """The profile of a source key. ValueError for an unknown one."""
    if key not in SITES:
        raise ValueError(f"no site {key}; there are {', '.join(SITES)}")
    return SITES[key]


def article_links(pages: DataFrame, profile: Site, most: int | None = None) -> DataFrame:
    """(link, first_page, first_pos) of the distinct article links of pages (page_id, html), where they stand first; ``most`` of them in that order."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href")).where(profile.wanted(F.col("href")))
    link = F.when(F.startswith("href", F.lit("/")), F.concat(F.lit(profile.prefix), "href")).otherwise(F.col("href"))
    first = found.groupBy(link.alias("link")).agg(F.min(F.struct("page_id", "pos")).alias("first")).select("link", F.col("first.page_id").alias("first_page"), F.col("first.pos").alias("first_pos"))
    return first.orderBy("first_page", "first_pos", "link").limit(most) if most is not None else first


def articles(pages: DataFrame, source: str, least_ratio: float = 0.6) -> DataFrame:
    """(page_id, url, title, content, date, source, content_hash) of the pages (page_id, url, html) that make articles.

    Pages whose script share is under ``least_ratio`` go, and those whose content an earlier page has; so do all but
    the first page of an address.
    """
    read = pages.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("p.page_id", "url", article("p.html").alias("a"))
    cleaned = T.held(read.select("page_id", "url", T.clean_scraped("a.title").alias("title"), "a.content", "a.date"), "content", T.clean_scraped("content"))
    kept = cleaned.where((T.script_ratio("content") >= least_ratio) & (F.col("content") != "")).withColumn("content_hash", F.md5("content"))
    first = kept.groupBy("content_hash").agg(F.min("page_id").alias("page_id"))
    return kept.join(first, ["content_hash", "page_id"], "left_semi").select("page_id", "url", "title", "content", "date", F.lit(source).alias("source"), "content_hash")
