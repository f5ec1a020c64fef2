"""The whole analysis: topics, labels, projection and coverage report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import gap, labels, layout, topics
from lacuna.operators.explore import pages_by_source
from lacuna.operators.lineage import cut
from lacuna.schemas import COMPETITOR, OWN, Settings
from lacuna.sources import reports
from lacuna.sources.page_table import PageTable
from lacuna.sources.pages import patch_pages, with_defaults

GRAPH, AXES = "graph", "axes"


@dataclass
class Analysis:
    assignments: DataFrame
    pages: DataFrame
    projection: DataFrame
    report: DataFrame
    summary: DataFrame


def find_topics(pages: DataFrame, min_cluster_size: int = 5) -> DataFrame:
    """(page_id, cluster_id, cluster_label) of all competitor pages that have a vector."""
    competitor = with_defaults(pages_by_source(pages, COMPETITOR)).filter(
        F.col("vector").isNotNull())
    if competitor.isEmpty():
        raise ValueError("no competitor pages stored")
    found = cut(topics.cluster_pages(competitor.select("page_id", "vector"), min_cluster_size))
    members = competitor.select("page_id", "title", "keywords").join(found, "page_id")
    return cut(labels.assign_labels(found, labels.topic_labels(members)))


def project(pages: DataFrame, method: str = GRAPH, settings: Settings = Settings(),
            **options) -> DataFrame:
    """Projection table of all pages; ``method`` is graph or axes."""
    pages = with_defaults(pages).filter(F.col("vector").isNotNull())
    if pages.isEmpty():
        raise ValueError("no vectors stored")
    vectors = pages.select("page_id", "vector")
    if method == AXES:
        placed = layout.principal_axes(vectors)
    elif method == GRAPH:
        placed = layout.neighbour_layout(
            vectors, settings.n_neighbors, settings.min_dist, settings.random_state, **options)
    else:
        raise ValueError(f"unknown projection: {method}")
    return reports.projection_table(pages.drop("vector").join(placed, "page_id"))


def coverage(pages: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(report, summary) of pages that already carry their topics."""
    pages = with_defaults(pages)
    if pages_by_source(pages, OWN).isEmpty():
        raise ValueError("no own pages stored")
    if pages_by_source(pages, COMPETITOR).isEmpty():
        raise ValueError("no competitor pages stored")
    if gap.clustered(pages).isEmpty():
        raise ValueError("no page belongs to a topic; run the clustering first")
    report = cut(gap.gap_report(pages, threshold))
    return (report.orderBy("coverage_score", "first_page_id"),
            gap.gap_summary(report, pages, threshold))


def analyze(pages: DataFrame, settings: Settings = Settings(), method: str = GRAPH,
            **options) -> Analysis:
    assignments = find_topics(pages, settings.min_cluster_size)
    placed = cut(patch_pages(pages, assignments))
    projection = project(placed, method, settings, **options)
    report, summary = coverage(placed, settings.coverage_threshold)
    return Analysis(assignments, placed, projection, report, summary)


def analyze_table(table: PageTable, out: str, settings: Settings = Settings(),
                  method: str = GRAPH, **options) -> Analysis:
    """Analyse a stored page table, write topics back to it and the reports to ``out``."""
    result = analyze(table.read(), settings, method, **options)
    table.patch(result.assignments)
    reports.write_clusters(result.assignments, f"{out}/clusters")
    reports.write_projection(result.projection, f"{out}/projection")
    reports.write_gap_report(result.report, result.summary, f"{out}/gap")
    return result
