"""Readers and the pure merge operators of the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.schemas import NOISE_ID, PAGE_SCHEMA, TEXT_FIELDS


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table with a fixed schema; ``source`` may be a partition column."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def with_defaults(pages: DataFrame) -> DataFrame:
    """Fill missing payload fields."""
    fills = {c: F.coalesce(c, F.lit("")) for c in TEXT_FIELDS if c in pages.columns}
    if "keywords" in pages.columns:
        fills["keywords"] = F.coalesce("keywords", F.array().cast("array<string>"))
    if "cluster_id" in pages.columns:
        fills["cluster_id"] = F.coalesce("cluster_id", F.lit(NOISE_ID))
    return pages.withColumns(fills)


def latest_pages(rows: DataFrame) -> DataFrame:
    """One row per page id: the newest by (timestamp, seq, arrival), taken whole.

    ``arrival`` (order inside a delivery) is optional. What still ties is ordered by a
    hash of the whole row, so no layout or retry changes the winner. The rank filter also runs before the shuffle, so a page delivered very often
    leaves each map task as one row.
    """
    order = [F.desc(c) for c in ("timestamp", "seq", "arrival") if c in rows.columns]
    w = Window.partitionBy("page_id").orderBy(*order, F.xxhash64(*sorted(rows.columns)))
    return (rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
            .drop("rn", "seq", "arrival"))


def upsert_pages(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Last write wins per page id; a page written again loses its topic.

    ``batch`` may carry ``seq`` (order of delivery); at equal timestamps it is
    newer than the store. Stored rows are only filtered by the ids they lose
    to, so with a small batch the wide store is neither shuffled nor sorted. The
    batch is read several times: pass a stored table.
    """
    if "seq" not in batch.columns:
        batch = batch.withColumn("seq", F.lit(1).cast("bigint"))
    newest = latest_pages(batch)
    stored = store.select("page_id", F.col("timestamp").alias("_stored"))
    offered = newest.select("page_id", F.col("timestamp").alias("_new"))
    late = stored.join(offered, "page_id").filter(
        F.col("_stored").isNotNull()
        & F.coalesce(F.col("_new") < F.col("_stored"), F.lit(True))).select("page_id")
    winners = newest.join(late, "page_id", "left_anti")
    kept = store.join(winners.select("page_id"), "page_id", "left_anti")
    return kept.unionByName(winners, allowMissingColumns=True).select(*store.columns)


def patch_pages(store: DataFrame, patch: DataFrame) -> DataFrame:
    """Set cluster_id and cluster_label on listed ids; all else stays."""
    news = patch.select(
        "page_id", F.col("cluster_id").alias("_id"), F.col("cluster_label").alias("_label"))
    return store.join(news, "page_id", "left").withColumns({
        "cluster_id": F.coalesce("_id", "cluster_id"),
        "cluster_label": F.coalesce("_label", "cluster_label"),
    }).select(*store.columns)
