"""Search-query lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = r"""(?m)^[ \t]*-[ \t]+(?:"([^"\n]*)"|'([^'\n]*)'|([^"'\s#][^#\n]*?))[ \t]*(?:#.*)?$"""


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(seq, query) of a YAML list file, in file order.

    A query list is a small parameter file; it is read as one text so that the
    order of its lines is certain.
    """
    text = spark.read.text(path, wholetext=True)
    item = F.posexplode(F.regexp_extract_all("value", F.lit(_ITEM), F.lit(0)))
    rows = text.select(item.alias("seq", "line"))

    def part(i: int):
        return F.nullif(F.regexp_extract("line", _ITEM, i), F.lit(""))

    queries = rows.select(
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(part(1), part(2), F.trim(part(3)), F.lit("")).alias("query"))
    return first_queries(queries, limit)


def first_queries(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """The ``limit`` queries with the smallest sequence numbers; 0 or None keeps all."""
    return queries.orderBy("seq", "query").limit(limit) if limit else queries
