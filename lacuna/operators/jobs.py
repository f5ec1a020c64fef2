"""Job status table as bulk DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Job states and how much of an error text is stored and listed.
STATUSES = ("pending", "in_progress", "done", "failed")
ERROR_CHARS = 2000
ERROR_SHOWN_CHARS = 120


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def new_jobs(queries: DataFrame, now: Column) -> DataFrame:
    """(seq, query) as pending jobs, each query once."""
    first = queries.groupBy("query").agg(F.min("seq").alias("seq"))
    return first.select(
        "seq", "query", F.lit("pending").alias("status"), now.alias("created_at"),
        _null("timestamp").alias("started_at"), _null("timestamp").alias("finished_at"),
        _null("string").alias("error"))


def seed_jobs(jobs: DataFrame, queries: DataFrame, now: Column, reset: bool = False) -> DataFrame:
    """Add queries that have no job yet; ``reset`` starts from an empty table.

    New jobs keep the order of their list and come after all jobs there are.
    """
    fresh = new_jobs(queries, now)
    if reset:
        return fresh
    fresh = fresh.join(jobs.select("query"), "query", "left_anti")
    shift = jobs.agg(F.max("seq").alias("last")).crossJoin(
        F.broadcast(fresh.agg(F.min("seq").alias("first")))).select(
        F.coalesce(F.col("last") + 1 - F.col("first"), F.lit(0)).alias("shift"))
    moved = fresh.crossJoin(F.broadcast(shift))  # one row
    return jobs.unionByName(moved.withColumn("seq", F.col("seq") + F.col("shift")).drop("shift"))


def reset_stale(jobs: DataFrame, now: Column, minutes: int = 120) -> DataFrame:
    """Jobs in progress for longer than ``minutes`` become pending again."""
    stale = ((F.col("status") == "in_progress")
             & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))))
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumns({
        "status": F.when(stale, "pending").otherwise(F.col("status")),
        "started_at": F.when(stale, _null("timestamp")).otherwise(F.col("started_at"))})


def retry_failed(jobs: DataFrame) -> DataFrame:
    bad = F.col("status") == "failed"
    return jobs.withColumns({
        "status": F.when(bad, "pending").otherwise(F.col("status")),
        "started_at": F.when(bad, _null("timestamp")).otherwise(F.col("started_at")),
        "finished_at": F.when(bad, _null("timestamp")).otherwise(F.col("finished_at")),
        "error": F.when(bad, _null("string")).otherwise(F.col("error"))})


def count_failed(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "failed").alias("reset_jobs"))


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply (query, outcome, at, error); the last outcome of a query wins.

    ``done`` and ``failed`` keep the start time, ``pending`` clears it. A job
    keeps its old error unless the outcome is ``failed``.
    """
    w = Window.partitionBy("query").orderBy(
        F.desc("at"), F.desc("outcome"), F.desc("error"))
    last = (outcomes.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
            .select("query", "outcome", "at", F.col("error").alias("new_error")))
    outcome = F.col("outcome")
    return jobs.join(last, "query", "left").select(
        "seq", "query",
        F.coalesce(outcome, F.col("status")).alias("status"),
        "created_at",
        F.when(outcome == "pending", _null("timestamp"))
        .otherwise(F.col("started_at")).alias("started_at"),
        F.when(outcome.isin("done", "failed"), F.col("at"))
        .otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(outcome == "failed", F.substring("new_error", 1, ERROR_CHARS))
        .otherwise(F.col("error")).alias("error"))


def next_batch(jobs: DataFrame, n: int = 1) -> DataFrame:
    """First pending jobs in insertion order."""
    return jobs.filter(F.col("status") == "pending").orderBy("seq").limit(n)


def start_jobs(jobs: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Mark the jobs of ``batch`` as in progress."""
    mine = batch.select("query", F.lit(True).alias("claimed"))
    taken = F.coalesce("claimed", F.lit(False))
    return (jobs.join(mine, "query", "left").withColumns({
        "status": F.when(taken, "in_progress").otherwise(F.col("status")),
        "started_at": F.when(taken, now).otherwise(F.col("started_at"))}).drop("claimed"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """One row: a count per status (0 when absent) and the total."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return jobs.agg(*counts, F.count(F.lit(1)).alias("total"))


def failed_jobs(jobs: DataFrame, shown: int | None = None) -> DataFrame:
    error = F.col("error") if shown is None else F.substring("error", 1, shown)
    return jobs.filter(F.col("status") == "failed").select("query", error.alias("error"))
