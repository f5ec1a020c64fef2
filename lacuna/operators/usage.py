"""Token usage totals and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# USD per million tokens.
PRICE_EMBEDDING = 0.020
PRICE_INPUT = 0.150
PRICE_OUTPUT = 0.600
MILLION = 1_000_000

EMBEDDING = "embedding"
CHAT = "llm"


def usage_totals(events: DataFrame) -> DataFrame:
    """One row of totals. Each embedding call stands for one processed page."""
    embedding = F.col("kind") == EMBEDDING
    chat = F.col("kind") == CHAT

    def total(cond: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(column))), F.lit(0)).cast("bigint")

    return events.agg(
        F.count_if(embedding).alias("pages_processed"),
        total(embedding, "input_tokens").alias("embedding_tokens"),
        total(chat, "input_tokens").alias("llm_input_tokens"),
        total(chat, "output_tokens").alias("llm_output_tokens"))


def cost() -> Column:
    return (F.col("embedding_tokens") / MILLION * PRICE_EMBEDDING
            + F.col("llm_input_tokens") / MILLION * PRICE_INPUT
            + F.col("llm_output_tokens") / MILLION * PRICE_OUTPUT)


def usage_cost(totals: DataFrame) -> DataFrame:
    return totals.withColumn("estimated_cost_usd", F.round(cost(), 6))


def usage_projection(totals: DataFrame, total_pages: int | None) -> DataFrame:
    """Cost extrapolated to ``total_pages``; NULL without a target or without pages."""
    target = F.lit(total_pages or 0)
    pages = F.col("pages_processed")
    projected = F.when((target > 0) & (pages > 0), F.round(cost() * target / pages, 4))
    return usage_cost(totals).withColumn("projected_cost_usd", projected)
