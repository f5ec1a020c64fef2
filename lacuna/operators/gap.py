"""Coverage of topics by own pages: centroids, nearest own page, report, summary."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.lineage import cut
from lacuna.schemas import COMPETITOR, NOISE_ID, OWN

# Centroids travel in slabs of about this many topics (at 1536 numbers per vector some
# 6 MB), and so many slabs are broadcast at a time.
SLAB_TOPICS = 512
SLABS_AT_ONCE = 16

# Topics whose sums a task holds before it hands them on.
HELD_TOPICS = 4096

# Distances are compared after rounding to this many decimals, so that equal
# vectors tie no matter in which matrix product they were multiplied.
DISTANCE_DECIMALS = 10


def clustered(pages: DataFrame) -> DataFrame:
    """Competitor pages that belong to a topic."""
    return pages.filter(
        (F.col("source") == COMPETITOR) & (F.col("cluster_id") != NOISE_ID))


class _TopicSums:
    """Vector sums, page counts and first pages of topics, added batch by batch."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = {}
        self.first: dict[int, tuple] = {}

    def add(self, ids, rows, counts, page_ids, labels) -> None:
        """Rows of one topic need not be neighbours; ``rows`` is a matrix."""
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        sums = np.add.reduceat(rows[order], starts, axis=0)
        sizes = np.add.reduceat(counts[order], starts)
        for topic, total, n in zip(ids[starts].tolist(), sums, sizes.tolist()):
            self.sums[topic] = self.sums[topic] + total if topic in self.sums else total
            self.counts[topic] = self.counts.get(topic, 0) + n
        for topic, page, label in zip(ids.tolist(), page_ids[order], labels[order]):
            first = (page, label is None, label or "")  # equal ids: smallest label, none last
            if topic not in self.first or first < self.first[topic]:
                self.first[topic] = first

    def flush(self, finish=lambda total: total) -> pd.DataFrame:
        topics = list(self.sums)
        out = pd.DataFrame({
            "cluster_id": np.array(topics, dtype=np.int32),
            "centroid": [finish(self.sums[t]) for t in topics],
            "page_count": np.array([self.counts[t] for t in topics], dtype=np.int64),
            "cluster_label": [None if self.first[t][1] else self.first[t][2] for t in topics],
            "first_page_id": [self.first[t][0] for t in topics]})
        self.__init__()
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay."""
    size = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
    return rows / np.where(size > 0, size, 1.0)


def _partial_sums(batches):
    """Sums of unit vectors by topic, one row per topic and task as long as HELD_TOPICS suffice."""
    held = _TopicSums()
    for pdf in batches:
        if len(pdf):
            rows = _unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
            held.add(pdf["cluster_id"].to_numpy(), rows, np.ones(len(pdf), dtype=np.int64),
                     pdf["page_id"].to_numpy(), pdf["cluster_label"].to_numpy())
            if len(held.sums) > HELD_TOPICS:
                yield held.flush()
    if held.sums:
        yield held.flush()


def _merge_sums(batches):
    """Unit centroids of the topics of one partition, which has all their partial sums."""
    held = _TopicSums()
    for pdf in batches:
        if len(pdf):
            held.add(pdf["cluster_id"].to_numpy(), np.stack(pdf["centroid"].to_numpy()),
                     pdf["page_count"].to_numpy(), pdf["first_page_id"].to_numpy(), pdf["cluster_label"].to_numpy())
    if held.sums:
        yield held.flush(_unit)


_TOPIC = "cluster_id int, centroid array<double>, page_count bigint, cluster_label string, first_page_id string"


def centroids(pages: DataFrame) -> DataFrame:
    """One row per topic: unit centroid, size, label and id of its first page.

    Pages without a vector have no place to be near to and are not counted. Tasks add up
    the vectors of their own pages, so what moves is a sum per topic and task, and nothing is sorted.
    """
    placed = clustered(pages).filter(F.col("vector").isNotNull()).select(
        "cluster_id", "cluster_label", "page_id", "vector")
    return (placed.mapInPandas(_partial_sums, _TOPIC).repartition("cluster_id")
            .mapInPandas(_merge_sums, _TOPIC))


def _pack_own(batches):
    """One row per Arrow batch: own pages by id and their stacked unit vectors."""
    for pdf in batches:
        if len(pdf):
            pdf = pdf.sort_values("page_id", kind="stable")
            rows = _unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
            yield pd.DataFrame({
                "ids": [pdf["page_id"].tolist()], "urls": [pdf["url"].tolist()],
                "titles": [pdf["title"].tolist()], "own_flat": [rows.ravel()]})


def _slab_minimum(batches):
    """Per block of own pages and slab of topics: the nearest page of each topic."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            own = np.asarray(row.own_flat).reshape(len(row.ids), -1)
            topics = np.asarray(row.topic_flat).reshape(len(row.topic_ids), -1)
            dist = np.round(1.0 - own @ topics.T, DISTANCE_DECIMALS)
            best = dist.argmin(axis=0)
            yield pd.DataFrame({
                "cluster_id": np.asarray(row.topic_ids, dtype=np.int32),
                "distance": dist[best, np.arange(len(best))],
                "page_id": np.asarray(row.ids, dtype=object)[best],
                "url": np.asarray(row.urls, dtype=object)[best],
                "title": np.asarray(row.titles, dtype=object)[best]})


_PACKED = "ids array<string>, urls array<string>, titles array<string>, own_flat array<double>"
_WINNERS = "cluster_id int, distance double, page_id string, url string, title string"


def nearest_own(pages: DataFrame, topics: DataFrame, slab_topics: int = SLAB_TOPICS,
                slabs_at_once: int = SLABS_AT_ONCE, topic_count: int | None = None) -> DataFrame:
    """Nearest own page of every topic: (cluster_id, distance, page_id, url, title).

    Own pages never move: each task packs its own batches and meets the slabs of
    centroids, of which at most ``slabs_at_once`` are broadcast for one pass over the own pages. It
    keeps one winner per topic and batch, and the winners are min-combined map-side. Unless
    ``topic_count`` is given, topics are counted first with a scan that reads no vectors;
    the count bounds what is broadcast.
    """
    if topic_count is None:
        topic_count = clustered(pages).select("cluster_id").distinct().count()
    slabs = max(1, math.ceil(topic_count / slab_topics))
    passes = math.ceil(slabs / slabs_at_once)

    packed = topics.groupBy(F.pmod(F.hash("cluster_id"), F.lit(slabs)).alias("slab")).agg(
        F.collect_list("cluster_id").alias("topic_ids"),
        F.flatten(F.collect_list("centroid")).alias("topic_flat"))
    if passes > 1:
        packed = cut(packed)  # not to be computed for every pass

    blank = F.lit("")
    own = (pages.filter((F.col("source") == OWN) & F.col("vector").isNotNull())
           .select("page_id", F.coalesce("url", blank).alias("url"),
                   F.coalesce("title", blank).alias("title"), "vector")
           .mapInPandas(_pack_own, _PACKED))

    def winners(number: int) -> DataFrame:
        slab = packed.filter(F.col("slab") % passes == number) if passes > 1 else packed
        # every block meets every slab of the pass
        return own.crossJoin(F.broadcast(slab.drop("slab"))).mapInPandas(_slab_minimum, _WINNERS)

    found = functools.reduce(DataFrame.unionByName, map(winners, range(passes)))
    return found.groupBy("cluster_id").agg(
        F.min(F.struct("distance", "page_id", "url", "title")).alias("best")).select(
        "cluster_id", "best.*")


def coverage_score(distance, threshold: float):
    if threshold <= 0:
        raise ValueError("the coverage threshold must be above zero")
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(float(threshold))), 4)


def gap_clusters(pages: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Gap report without examples, least covered topic first."""
    topics = centroids(pages)
    best = nearest_own(pages, topics.select("cluster_id", "centroid"))
    d = F.col("distance")
    return (
        topics.drop("centroid").join(best, "cluster_id")
        .select(
            "cluster_id", "cluster_label", "page_count",
            (d <= F.lit(float(threshold))).alias("covered"),
            coverage_score(d, threshold).alias("coverage_score"),
            F.round(d, 4).alias("min_distance_to_own"),
            F.struct("url", "title", F.round(d, 4).alias("distance")).alias("best_own_page"),
            "first_page_id")
        .orderBy("coverage_score", "first_page_id"))


def first_examples(pages: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` pages of each topic by page id, one row per page."""
    w = Window.partitionBy("cluster_id").orderBy("page_id")
    rows = clustered(pages)
    keywords = (F.coalesce("keywords", F.array().cast("array<string>"))
                if "keywords" in rows.columns else F.array().cast("array<string>"))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "domain", "summary")]
    return (rows.select("cluster_id", "page_id", *text, keywords.alias("keywords"))
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= n))


def example_lists(pages: DataFrame, n: int = 5) -> DataFrame:
    """Examples as one array of structs per topic."""
    page = F.struct("rn", F.struct("url", "title", "domain", "summary", "keywords").alias("page"))
    return first_examples(pages, n).groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(page)).alias("ordered")).select(
        "cluster_id", F.transform("ordered", lambda e: e["page"]).alias("example_pages"))


def gap_report(pages: DataFrame, threshold: float = 0.3, max_examples: int = 5) -> DataFrame:
    """Full gap report with nested examples, least covered topic first."""
    report = gap_clusters(pages, threshold).join(
        example_lists(pages, max_examples), "cluster_id")
    return report.select(
        "cluster_id", "cluster_label", "page_count", "covered", "coverage_score",
        "min_distance_to_own", "best_own_page", "example_pages", "first_page_id",
    ).orderBy("coverage_score", "first_page_id")


def gap_summary(report: DataFrame, pages: DataFrame, threshold: float) -> DataFrame:
    """Totals of a report; competitor pages include noise."""
    topics = report.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.count_if("covered").alias("covered_clusters"),
        F.count_if(~F.col("covered")).alias("missing_clusters"))
    stored = pages.agg(
        F.count_if(F.col("source") == OWN).alias("own_pages_count"),
        F.count_if(F.col("source") == COMPETITOR).alias("competitor_pages_count"))
    return topics.crossJoin(F.broadcast(stored)).select(  # one row each
        "total_clusters", "covered_clusters", "missing_clusters",
        F.lit(float(threshold)).alias("coverage_threshold"),
        "own_pages_count", "competitor_pages_count")


def coverage_percent(summary: DataFrame) -> DataFrame:
    total = F.greatest(F.col("total_clusters"), F.lit(1))
    return summary.withColumn(
        "coverage_pct",
        F.bround(F.col("covered_clusters") / total * 100, 0).cast("bigint"))


def filter_report(report: DataFrame, show: str = "all", min_pages: int = 1) -> DataFrame:
    """``show`` is one of all, missing, covered."""
    if show == "missing":
        report = report.filter(~F.col("covered"))
    elif show == "covered":
        report = report.filter(F.col("covered"))
    elif show != "all":
        raise ValueError(f"unknown filter: {show}")
    return report.filter(F.col("page_count") >= min_pages)


def top_clusters(report: DataFrame, n: int = 12) -> DataFrame:
    """Largest topics; equal sizes keep report order."""
    return (report.orderBy(F.desc("page_count"), "coverage_score", "first_page_id").limit(n)
            .select(F.substring("cluster_label", 1, 30).alias("label"),
                    F.col("page_count").alias("pages"), "covered"))


def report_cards(report: DataFrame) -> DataFrame:
    """Display texts of a full report: percent, first three examples, closest page."""
    best = F.col("best_own_page")
    shown = F.transform(F.slice("example_pages", 1, 3), lambda e: F.concat(
        F.coalesce(F.nullif(F.substring(e["title"], 1, 70), F.lit("")),
                   F.substring(e["url"], 1, 70)),
        F.lit(" — "), e["domain"]))
    return report.select(
        "cluster_id", "cluster_label", "page_count", "covered",
        F.floor(F.col("coverage_score") * 100).cast("bigint").alias("score_pct"),
        F.array_join(shown, "\n").alias("examples"),
        F.coalesce(F.nullif(F.substring(best["title"], 1, 70), F.lit("")),
                   F.substring(best["url"], 1, 60)).alias("closest_page"))
