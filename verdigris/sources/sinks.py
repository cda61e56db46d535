"""Results as files: audit records with personal data masked, one folder a split, and answers by section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import masked_deep

def write_audit(df: DataFrame, path: str, masking: bool = True) -> None:
    """One JSON record a row; with masking, personal data in strings (however deep) is masked before they become JSON, so
    numbers and keys stay as they are.
    """
    columns = [masked_deep(df[f.name], f.dataType).alias(f.name) if masking else df[f.name] for f in df.schema.fields]
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each value of the split column."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def section_totals(answers: DataFrame, section: str = "section", status: str = "status") -> DataFrame:
    """Answers by status for each section and overall (section null); those not applicable don't count in shares."""
    counted = answers.rollup(section).agg(
        F.count_if(F.col(status) == "answered").alias("answered"), F.count_if(F.col(status) == "partial").alias("partial"), F.count_if(F.col(status) == "missing").alias("missing"),
    )
    whole = F.col("answered") + F.col("partial") + F.col("missing")
    return counted.withColumn("answered_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("answered"), whole), 1), F.lit(0.0)))
