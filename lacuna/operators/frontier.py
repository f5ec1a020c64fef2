"""Crawl frontier: which result domains to fetch, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text as tx
from lacuna.schemas import COMPETITOR


def top_results(results: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` organic results of each query."""
    w = Window.partitionBy("query").orderBy("rank", "url")
    return (results.filter(~F.col("sponsored"))
            .withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= k))


def domain_counts(pages: DataFrame) -> DataFrame:
    """Stored competitor pages per domain."""
    return (pages.filter(F.col("source") == COMPETITOR).groupBy("domain")
            .agg(F.count(F.lit(1)).alias("page_count")))


def check_domains(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, known, page_count) once per candidate domain.

    Both sides are reduced to one row per domain before they meet, so a domain
    with very many candidates or pages joins as a single row.
    """
    wanted = candidates.select("domain").distinct()
    count = F.coalesce("page_count", F.lit(0))
    return wanted.join(domain_counts(pages), "domain", "left").select(
        "domain", (count > 0).alias("known"), count.alias("page_count"))


def unknown_domains(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    stored = pages.filter(F.col("source") == COMPETITOR).select("domain").distinct()
    return candidates.select("domain").distinct().join(stored, "domain", "left_anti")


def frontier_actions(candidates: DataFrame, pages: DataFrame, enough: int = 5) -> DataFrame:
    """crawl an unknown domain, skip a well covered one, recrawl the rest."""
    return check_domains(candidates, pages).withColumn(
        "action",
        F.when(~F.col("known"), "crawl")
        .when(F.col("page_count") >= enough, "skip").otherwise("recrawl"))


def cap_pages(urls: DataFrame, cap: int = 100) -> DataFrame:
    """At most ``cap`` URLs per domain, in URL order."""
    w = Window.partitionBy("domain").orderBy("url")
    return (urls.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= cap))


def incomplete_domains(pages: DataFrame, least: int = 3) -> DataFrame:
    """Stored domains with their count and whether it is too low."""
    return domain_counts(pages).withColumn("incomplete", F.col("page_count") < least)


def discover_links(pages: DataFrame) -> DataFrame:
    """Distinct (url, domain, link, link_domain) found in page html."""
    # the outer form keeps Spark from adding a size filter that scans the html twice
    found = pages.select(
        "url", tx.domain_of(F.col("url")).alias("domain"),
        F.explode_outer(F.array_distinct(tx.hrefs(F.col("html")))).alias("href"))
    links = found.select(
        "url", "domain", tx.resolve_link(F.col("url"), F.col("href")).alias("link"))
    return (links.filter(F.col("link").isNotNull())
            .withColumn("link_domain", tx.domain_of(F.col("link"))).distinct())


def same_domain(links: DataFrame) -> DataFrame:
    return links.filter(F.col("link_domain") == F.col("domain"))


def site_map(pages: DataFrame, cap: int = 100) -> DataFrame:
    """URLs known per domain from page links, same domain only, capped."""
    links = same_domain(discover_links(pages))
    return cap_pages(
        links.select("domain", F.col("link").alias("url")).distinct(), cap)


def crawl_report(actions: DataFrame, fetched: DataFrame, min_chars: int = 1) -> DataFrame:
    """Per domain: the action taken, pages saved and pages that failed.

    ``fetched`` holds one row per page with its domain and content; a page with
    less than ``min_chars`` of text has failed.
    """
    good = F.coalesce(F.length(F.trim("content")) >= min_chars, F.lit(False))
    pages = fetched.select("domain", good.alias("good")).groupBy("domain").agg(
        F.count_if("good").alias("saved"), F.count_if(~F.col("good")).alias("failed"))
    zero = F.lit(0)
    return actions.join(pages, "domain", "left").select(
        "domain", "action", "known",
        F.coalesce("saved", zero).alias("saved"), F.coalesce("failed", zero).alias("failed"))


def crawl_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(~F.col("known")).alias("new_domains"),
        F.count_if("known").alias("known_domains"),
        F.sum("saved").alias("saved"), F.sum("failed").alias("failed"))
