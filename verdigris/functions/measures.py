"""Scalar measures shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_delta(claim: Column, evidence: Column) -> Column:
    """|claim - evidence| / |evidence|, null where there is no evidence or it is 0."""
    return F.try_divide(F.abs(claim - evidence), F.abs(evidence))


def saturating(x: Column, full: float) -> Column:
    """x / full, at most 1."""
    return F.least(F.lit(1.0), x / F.lit(full))


def risk_level(score: Column, medium: float = 0.25, high: float = 0.5) -> Column:
    return F.when(score < medium, "low").when(score < high, "medium").otherwise("high")


def yoy_percent(current: Column, previous: Column) -> Column:
    return F.round(F.try_divide(current - previous, F.abs(previous)) * 100, 3)


def cagr_percent(first: Column, last: Column, years: Column) -> Column:
    return F.when((first > 0) & (years > 0), F.round((F.pow(last / first, 1 / years) - 1) * 100, 3))


def pct_diff(a: Column, b: Column) -> Column:
    """Difference from b in per cent; 0 against 0 is 0, anything against 0 is 100."""
    return F.when((b == 0) & (a == 0), 0.0).when(b == 0, 100.0).otherwise(F.abs(a - b) / F.abs(b) * 100)


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    return sum((text.contains(p).cast("int") for p in phrases[1:]), text.contains(phrases[0]).cast("int"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\r]+"), lambda w: w != "")
