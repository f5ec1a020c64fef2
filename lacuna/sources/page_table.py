"""A page table on shared storage: immutable snapshots plus appended deliveries.

Layout below the root: ``snapshots/v=<n>`` (full table, partitioned by source),
``deliveries/batch=<id>`` (rows not yet merged), ``topics/patch=<n>`` (topic ids and labels
set since, without any vector) and ``log`` (one row per commit). A snapshot's commit is the appended log
row, so a failed write leaves the table unchanged. Deliveries and patches cost their own
size only; ``compact`` folds them into a new snapshot. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.schemas import PAGE_SCHEMA
from lacuna.sources.pages import read_pages, upsert_pages

_DELIVERY = T.StructType([*PAGE_SCHEMA.fields, T.StructField("batch", T.LongType())])
# ``after`` is the last delivery that a patch knows of, ``version`` the snapshot it lies upon
_PATCH = "page_id string, cluster_id int, cluster_label string, after bigint, version int, patch bigint"
_LOG = "version int, merged_batch bigint"


def _or_none(read):
    """Result of ``read``, or None when the path does not exist yet."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class PageTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _head(self) -> tuple[int, int]:
        """Current snapshot version and the last delivery merged into it."""
        log = _or_none(lambda: self.spark.read.schema(_LOG).json(f"{self.root}/log"))
        if log is None:
            return 0, -1
        row = log.agg(F.max(F.struct("version", "merged_batch")).alias("h")).first()
        return (row["h"]["version"], row["h"]["merged_batch"]) if row["h"] else (0, -1)

    def _snapshot(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], PAGE_SCHEMA)
        return read_pages(self.spark, f"{self.root}/snapshots/v={version}").select(*PAGE_SCHEMA.names)

    def _deliveries(self, after: int) -> DataFrame | None:
        rows = _or_none(
            lambda: self.spark.read.schema(_DELIVERY).parquet(f"{self.root}/deliveries"))
        return None if rows is None else rows.filter(F.col("batch") > after)

    def _patches(self, version: int) -> DataFrame | None:
        rows = _or_none(lambda: self.spark.read.schema(_PATCH).parquet(f"{self.root}/topics"))
        return None if rows is None else rows.filter(F.col("version") == version)

    def read(self) -> DataFrame:
        """The table as it is now.

        A patch holds for a page until a later delivery writes the page again; of several
        patches the last one holds.
        """
        version, merged = self._head()
        pages = self._snapshot(version).withColumn("batch", F.lit(merged).cast("bigint"))
        fresh = self._deliveries(merged)
        if fresh is not None:
            pages = upsert_pages(pages, fresh.withColumn("seq", F.col("batch")))
        patches = self._patches(version)
        if patches is None:
            return pages.select(*PAGE_SCHEMA.names)
        last = patches.groupBy("page_id").agg(F.max_by(
            F.struct("cluster_id", "cluster_label", "after"), F.struct("patch", "cluster_id", "cluster_label")).alias("p"))
        holds = F.coalesce(F.col("p.after") >= F.col("batch"), F.lit(False))
        return pages.join(last, "page_id", "left").withColumns({
            "cluster_id": F.when(holds, F.coalesce("p.cluster_id", "cluster_id")).otherwise(F.col("cluster_id")),
            "cluster_label": F.when(holds, F.coalesce("p.cluster_label", "cluster_label")).otherwise(F.col("cluster_label")),
        }).select(*PAGE_SCHEMA.names)

    def next_batch(self) -> int:
        """Smallest id above all deliveries so far."""
        return self._last_delivery(self._head()[1]) + 1

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch; delivering the same id again replaces it.

        An id that is already merged into a snapshot is taken for a replay and
        has no effect, so ids must rise (see ``next_batch``).
        """
        batch.select(*PAGE_SCHEMA.names).write.mode("overwrite").parquet(
            f"{self.root}/deliveries/batch={batch_id}")

    def _commit(self, table: DataFrame, merged: int) -> int:
        version = self._head()[0] + 1
        table.write.mode("overwrite").partitionBy("source").parquet(
            f"{self.root}/snapshots/v={version}")
        self.spark.range(1).select(
            F.lit(version).alias("version"), F.lit(merged).cast("bigint").alias("merged_batch"),
        ).write.mode("append").json(f"{self.root}/log")
        return version

    def _last_delivery(self, merged: int) -> int:
        fresh = self._deliveries(merged)
        if fresh is None:
            return merged
        last = fresh.agg(F.max("batch").alias("b")).first()["b"]
        return merged if last is None else last

    def compact(self) -> int:
        """Merge all deliveries into a new snapshot."""
        merged = self._last_delivery(self._head()[1])
        return self._commit(self.read(), merged)

    def patch(self, assignments: DataFrame) -> int:
        """Set topic ids and labels of the listed pages; writes no other column. Returns the patch's number."""
        version, merged = self._head()
        known = self._patches(version)
        last = known.agg(F.max("patch").alias("n")).first()["n"] if known is not None else None
        number = version * 1_000_000 if last is None else last + 1
        assignments.select(
            "page_id", "cluster_id", "cluster_label", F.lit(self._last_delivery(merged)).cast("bigint").alias("after"),
            F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{self.root}/topics/patch={number}")
        return number
