"""Joins of claims with evidence, series with themselves, and labels with the values near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cagr_percent, pct_diff, yoy_percent


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def series_edges(series: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Each period with the one before it, the change in per cent, and the growth rate since the first."""
    ordered = Window.partitionBy(*keys).orderBy(period)
    rows = series.withColumns({"previous": F.lag(value).over(ordered), "first_value": F.first(value).over(ordered), "first_period": F.first(period).over(ordered)})
    return rows.withColumns({"yoy": yoy_percent(F.col(value), F.col("previous")), "cagr": cagr_percent(F.col("first_value"), F.col(value), F.col(period) - F.col("first_period"))})


def cross_check(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of one metric and period from two origins, and how far they differ in per cent."""
    joined = left.withColumnRenamed(value, "a").join(right.withColumnRenamed(value, "b"), keys)
    return joined.withColumn("diff_pct", pct_diff(F.col("a"), F.col("b")))


def nearest_after(left: DataFrame, right: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """For each left row the first right row of its key in (at, at + within] by integer position.

    A range join by equal buckets: a right row meets the left rows of its bucket and the one before it.
    """
    a = left.withColumn("_bucket", F.floor(F.col(at) / within))
    b = right.select(key, F.col(at).alias("_at"), F.explode(F.array(F.floor(F.col(at) / within), F.floor(F.col(at) / within) - 1)).alias("_bucket"))
    met = a.join(b, [key, "_bucket"], "left").withColumn("_at", F.when((F.col("_at") > F.col(at)) & (F.col("_at") <= F.col(at) + within), F.col("_at")))
    return met.groupBy(*left.columns).agg(F.min("_at").alias("next_at"))
