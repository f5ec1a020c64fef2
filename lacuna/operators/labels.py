"""Readable topic labels from the keywords (or titles) of a topic's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.schemas import NOISE_ID

# Label texts and how many terms make a label.
SEPARATOR = " · "
NO_LABEL = "unlabelled"
NOISE_LABEL = "noise"
N_TERMS = 5
MIN_TITLE_WORD = 4

# Keys over which pages of no topic are spread when they meet their label.
NOISE_PARTS = 64

KEYWORD, TITLE, MARKER = "keyword", "title", "page"

_SPACE = r"(?U)[\s\x1c-\x1f]"


def _strip(text):
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def _label_terms(pages: DataFrame) -> DataFrame:
    """One row per keyword and title word of a page: (cluster_id, page_id, kind, pos, term).

    A marker row per page keeps topics that have no term at all. Unclassified
    pages give the marker only.
    """
    def entry(kind: str, pos, term):
        return F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), term.alias("term"))

    marker = F.array(entry(MARKER, F.lit(0), F.lit("")))
    words = F.transform(
        F.coalesce("keywords", F.array().cast("array<string>")),
        lambda k, i: entry(KEYWORD, i, F.lower(_strip(k))))
    title = F.transform(
        F.split(F.lower(F.coalesce("title", F.lit(""))), f"{_SPACE}+"),
        lambda w, i: entry(TITLE, i, w))
    real = F.col("cluster_id") != NOISE_ID
    # the outer form keeps Spark from adding a size filter that evaluates the
    # keyword expression a second time
    return pages.select(
        "cluster_id", "page_id",
        F.inline_outer(F.when(real, F.concat(marker, words, title)).otherwise(marker)))


def topic_labels(pages: DataFrame, n_terms: int = N_TERMS) -> DataFrame:
    """(cluster_id, cluster_label) for every cluster id in ``pages``, noise included.

    The most frequent keywords of a topic make its label, ties by first
    appearance. Titles are used only for topics whose pages hold no keyword
    entry at all; blank keywords count as entries and give ``unlabelled``.
    ``pages`` is read once, and terms are counted map-side before they move.
    """
    counted = _label_terms(pages).groupBy("cluster_id", "kind", "term").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "pos")).alias("first"))
    long_enough = F.length("term") >= F.when(F.col("kind") == TITLE, MIN_TITLE_WORD).otherwise(1)
    w = Window.partitionBy("cluster_id", "kind", "usable").orderBy(F.desc("n"), "first")
    top = (counted.withColumn("usable", long_enough)
           .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n_terms))

    def label(kind: str):
        chosen = F.when(F.col("usable") & (F.col("kind") == kind), F.struct("rn", "term"))
        terms = F.transform(F.sort_array(F.collect_list(chosen)), lambda e: e["term"])
        return F.nullif(F.array_join(terms, SEPARATOR), F.lit(""))

    grouped = top.groupBy("cluster_id").agg(
        label(KEYWORD).alias("kw"), label(TITLE).alias("tw"),
        F.max(F.col("kind") == KEYWORD).alias("entries"))
    return grouped.select(
        "cluster_id",
        F.when(F.col("cluster_id") == NOISE_ID, NOISE_LABEL)
        .when(F.col("entries"), F.coalesce("kw", F.lit(NO_LABEL)))
        .otherwise(F.coalesce("tw", F.lit(NO_LABEL))).alias("cluster_label"))


def assign_labels(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, cluster_id) with the label of its topic.

    Noise, which may be most pages, is spread over NOISE_PARTS keys of the join.
    """
    placed = assignments.select("page_id", "cluster_id")
    names = labels.select("cluster_id", "cluster_label")
    noise = F.col("cluster_id") == NOISE_ID
    named = names.filter(~noise).unionByName(
        # one row of noise stands for all of it where labels has any
        names.filter(noise).groupBy("cluster_id").agg(F.min("cluster_label").alias("cluster_label")))
    spread = F.when(noise, F.pmod(F.xxhash64("page_id"), F.lit(NOISE_PARTS))).otherwise(F.lit(0))
    copies = F.when(noise, F.sequence(F.lit(0), F.lit(NOISE_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return (placed.withColumn("part", spread.cast("int"))
            .join(named.withColumn("part", F.explode(copies)), ["cluster_id", "part"])
            .select("page_id", "cluster_id", "cluster_label"))
