"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.text import let


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit vector as ``array<double>``; a zero vector stays as it is."""
    return let(norm(vector), lambda n: F.when(
        n > 0, F.transform(vector, lambda x: x.cast("double") / n)
    ).otherwise(vector.cast("array<double>")))
