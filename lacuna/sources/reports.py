"""Report sinks and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.schemas import (
    CLUSTER_SCHEMA,
    GAP_CLUSTER_SCHEMA,
    GAP_SUMMARY_SCHEMA,
    PROJECTION_SCHEMA,
)


def flatten_keywords(pages: DataFrame) -> DataFrame:
    """Keywords as one comma-separated text."""
    if dict(pages.dtypes)["keywords"] == "array<string>":
        return pages.withColumn(
            "keywords", F.coalesce(F.array_join("keywords", ", "), F.lit("")))
    return pages.withColumn("keywords", F.col("keywords").cast("string"))


def projection_table(pages: DataFrame) -> DataFrame:
    """Page rows with x and y in the report's columns; the vector is dropped."""
    rows = flatten_keywords(pages).withColumnRenamed("page_id", "id")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in PROJECTION_SCHEMA])


def write_projection(table: DataFrame, path: str) -> None:
    table.drop("vector").write.mode("overwrite").parquet(path)


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECTION_SCHEMA).parquet(path)


def label_map(assignments: DataFrame) -> DataFrame:
    return assignments.select("cluster_id", "cluster_label").distinct()


def write_clusters(assignments: DataFrame, path: str) -> None:
    """Assignment rows and the id -> label map, both as JSON lines."""
    assignments.select(*CLUSTER_SCHEMA.names).write.mode("overwrite").json(f"{path}/clusters")
    label_map(assignments).write.mode("overwrite").json(f"{path}/labels")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTER_SCHEMA).json(f"{path}/clusters")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cluster_id int, cluster_label string").json(f"{path}/labels")


def write_gap_report(report: DataFrame, summary: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(f"{path}/clusters")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_gap_report(spark: SparkSession, path: str) -> DataFrame:
    """Report in its order: least covered topic first."""
    return spark.read.schema(GAP_CLUSTER_SCHEMA).json(f"{path}/clusters").orderBy(
        "coverage_score", "first_page_id")


def read_gap_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GAP_SUMMARY_SCHEMA).json(f"{path}/summary")
