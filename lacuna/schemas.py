"""Table schemas, payload defaults and job parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

OWN = "own"
COMPETITOR = "competitor"
NOISE_ID = -1

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("metadata_mode", T.StringType()),
    T.StructField("content_snippet", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("cluster_label", T.StringType()),
])

# Readers see '' for a missing text field, [] for missing keywords and -1 for a
# page that no clustering run has placed yet.
TEXT_FIELDS = (
    "url", "title", "domain", "source", "query", "summary",
    "cluster_label", "content_snippet",
)

PROJECTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("cluster_label", T.StringType()),
    T.StructField("content_snippet", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("x", T.FloatType()),
    T.StructField("y", T.FloatType()),
])

EXAMPLE_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
])

GAP_CLUSTER_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("cluster_label", T.StringType()),
    T.StructField("page_count", T.LongType()),
    T.StructField("covered", T.BooleanType()),
    T.StructField("coverage_score", T.DoubleType()),
    T.StructField("min_distance_to_own", T.DoubleType()),
    T.StructField("best_own_page", T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ])),
    T.StructField("example_pages", T.ArrayType(EXAMPLE_PAGE)),
    T.StructField("first_page_id", T.StringType()),
])

GAP_SUMMARY_SCHEMA = T.StructType([
    T.StructField("total_clusters", T.LongType()),
    T.StructField("covered_clusters", T.LongType()),
    T.StructField("missing_clusters", T.LongType()),
    T.StructField("coverage_threshold", T.DoubleType()),
    T.StructField("own_pages_count", T.LongType()),
    T.StructField("competitor_pages_count", T.LongType()),
])

CLUSTER_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("cluster_label", T.StringType()),
])

JOB_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

USAGE_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
])

# One line of an agent log that is a JSON object. Every field is read as text, nested ones as
# their JSON, so a field of an unexpected type never makes the line unreadable.
LOG_EVENT_SCHEMA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("type", "message", "name", "rate_limit_info", "subtype", "error")])


@dataclass(frozen=True)
class Settings:
    """Job parameters. Values are the defaults a run starts from."""

    # Defaults of the crawl and analysis parameters.
    k: int = 5
    max_pages_per_domain: int = 100
    known_domain_pages: int = 5
    complete_domain_pages: int = 3
    vector_size: int = 1536
    min_cluster_size: int = 3
    coverage_threshold: float = 0.3
    n_neighbors: int = 15
    min_dist: float = 0.1
    random_state: int = 42
    stale_minutes: int = 120
    silence_minutes: int = 15
    limit_wait_hours: int = 5
    default_metadata_mode: str = "tfidf"
