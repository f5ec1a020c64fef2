"""Cutting the lineage of iterative jobs on shared storage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="lacuna-work-")


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, named by ``spark.checkpoint.dir``.

    It must be shared storage on a cluster. Only a local master without the
    setting gets a temporary folder.
    """
    folder = spark.conf.get(FOLDER_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {FOLDER_SETTING} to a shared folder")
        folder = _local_folder()
    return folder.rstrip("/")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand at most ``rows`` rows at a time to Python in the jobs that run inside, for rows that are wide."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the work folder and read it back.

    The result survives the loss of executors, carries its true size for the
    choice of joins, and, unlike a checkpoint, none of the constraints that Spark
    infers, which would grow with every round of an iterative job. ``batch_rows`` bounds what Python gets at a time.
    """
    path = f"{work_folder(df.sparkSession)}/lacuna-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, batch_rows) if batch_rows else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
