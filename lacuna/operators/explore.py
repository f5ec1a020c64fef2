"""Store statistics and the interactive report queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.schemas import COMPETITOR, NOISE_ID, OWN

# Column order of the page listing.
LISTING_COLUMNS = ("source", "domain", "cluster_label", "title", "url", "keywords", "summary")

OWN_LAYER = "own"
NOISE_LAYER = "unclassified"


def pages_by_source(pages: DataFrame, source: str) -> DataFrame:
    return pages.filter(F.col("source") == source)


def own_pages(pages: DataFrame) -> DataFrame:
    """URL and title of own pages; the scan reads nothing else."""
    return pages_by_source(pages, OWN).select(
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"))


def domain_pages(pages: DataFrame, domain: str, source: str = COMPETITOR) -> DataFrame:
    return pages.filter((F.col("domain") == domain) & (F.col("source") == source))


def assigned(pages: DataFrame) -> DataFrame:
    """Pages placed in a topic."""
    return pages.filter(F.col("cluster_id") >= 0)


def store_stats(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source") == OWN).alias("own_pages"),
        F.count_if(F.col("source") == COMPETITOR).alias("competitor_pages"))


def competitor_domains(pages: DataFrame) -> DataFrame:
    return (pages_by_source(pages, COMPETITOR).select("domain")
            .filter(F.col("domain").isNotNull()).distinct().orderBy("domain"))


def distinct_counts(pages: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return pages.agg(
        count(F.when(F.col("source") == COMPETITOR, F.col("domain"))).alias("domains"),
        count(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"))


def dashboard(pages: DataFrame) -> DataFrame:
    """The four headline numbers in one scan."""
    return pages.agg(
        F.count_if(F.col("source") == OWN).alias("own_pages"),
        F.count_if(F.col("source") == COMPETITOR).alias("competitor_pages"),
        F.count_distinct(F.when(F.col("source") == COMPETITOR, F.col("domain"))).alias("domains"),
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"))


def top_domains(pages: DataFrame, n: int = 15) -> DataFrame:
    return (pages_by_source(pages, COMPETITOR).filter(F.col("domain").isNotNull())
            .groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))
            .orderBy(F.desc("pages"), "domain").limit(n))


def label_options(pages: DataFrame) -> DataFrame:
    return (assigned(pages).select("cluster_label").filter(F.col("cluster_label").isNotNull())
            .distinct().orderBy("cluster_label"))


def domain_options(pages: DataFrame) -> DataFrame:
    return (pages.select("domain").filter(F.col("domain").isNotNull())
            .distinct().orderBy("domain"))


def map_view(pages: DataFrame, labels: Sequence[str] = (), domains: Sequence[str] = (),
             show_noise: bool = False) -> DataFrame:
    """Rows of the topic map. Own pages pass every filter; an empty list filters nothing."""
    own = F.col("source") == OWN
    if labels:
        pages = pages.filter(F.col("cluster_label").isin(*labels) | own)
    if domains:
        pages = pages.filter(F.col("domain").isin(*domains) | own)
    if not show_noise:
        pages = pages.filter((F.col("cluster_id") >= 0) | own)
    return pages


def map_layers(view: DataFrame, show_noise: bool = False, id_col: str = "page_id") -> DataFrame:
    """One row per drawn layer: own pages, unclassified pages, every topic."""
    competitor = F.col("source") == COMPETITOR
    noise = F.col("cluster_id") == NOISE_ID
    view = view.filter((F.col("source") == OWN) | (competitor & (F.col("cluster_id") >= 0))
                       | (competitor & noise & F.lit(show_noise)))
    layer = (F.when(F.col("source") == OWN, OWN_LAYER).when(noise, NOISE_LAYER)
             .otherwise(F.col("cluster_id").cast("string")))
    return view.groupBy(layer.alias("layer")).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by("cluster_label", id_col).alias("first_label")).select(
        "layer", "points",
        F.when(F.col("layer").isin(OWN_LAYER, NOISE_LAYER), F.col("layer"))
        .otherwise(F.substring("first_label", 1, 35)).alias("label"))


def map_counts(view: DataFrame) -> DataFrame:
    """Points shown, and cluster ids among the competitor points (-1 counts when shown)."""
    return view.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct(F.when(F.col("source") == COMPETITOR, F.col("cluster_id")))
        .alias("clusters"))


def explore(pages: DataFrame, source: str | None = None, domain: str | None = None,
            label: str | None = None, search: str | None = None) -> DataFrame:
    """Page filters; None means all. ``search`` is a regular expression on title or URL."""
    for column, value in (("source", source), ("domain", domain), ("cluster_label", label)):
        if value is not None:
            pages = pages.filter(F.col(column) == value)
    if search:
        def hit(c: str):
            return F.coalesce(F.col(c).rlike(f"(?iu){search}"), F.lit(False))
        pages = pages.filter(hit("title") | hit("url"))
    return pages


def listing(pages: DataFrame) -> DataFrame:
    return pages.select(*[c for c in LISTING_COLUMNS if c in pages.columns])


def detail_rows(pages: DataFrame, n: int = 50, id_col: str = "page_id") -> DataFrame:
    """First ``n`` rows of a filtered set with their heading."""
    heading = F.coalesce(F.nullif(F.substring("title", 1, 80), F.lit("")), F.col("url"))
    return pages.withColumn("heading", heading).orderBy(id_col).limit(n)


def topic_quality(assignments: DataFrame) -> DataFrame:
    """Number of topics and share of unclassified pages."""
    return assignments.agg(
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("topics"),
        F.avg((F.col("cluster_id") == NOISE_ID).cast("double")).alias("noise_ratio"))
