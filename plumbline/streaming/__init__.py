"""Incremental refresh: additive moments of one-factor models over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments_by_level(rows: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """Counts and sums by level, on batch or stream: all that a one-factor, one-covariate fit needs."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))


def slope(levels: DataFrame) -> DataFrame:
    """The within-level slope and its standard error from moments_by_level()."""
    inner = lambda a, b, ab: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("n"))
    t = levels.agg(inner("sx", "sx", "sxx").alias("xx"), inner("sx", "sy", "sxy").alias("xy"), inner("sy", "sy", "syy").alias("yy"), (F.sum("n") - F.count(F.lit(1)) - 1).alias("df"))
    return t.select((F.col("xy") / F.col("xx")).alias("estimate"), F.sqrt((F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / F.col("df") / F.col("xx")).alias("std_error"))
