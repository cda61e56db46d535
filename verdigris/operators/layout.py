"""Tokens on pages: numbers in them, and the value that belongs to a label by column or by order.

tokens: doc, page, pos (reading order within the document), text, and x0, y0, x1, y1 from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME_COLUMN, AHEAD = 0.06, 5
NUMBERS = r"\d+(?:[,\s]+\d{3})*(?:\.\d+)?"
#: The same matches without giving back, so that a long token isn't matched by recursion.
LONG_NUMBERS = r"\d++(?:[,\s]++\d{3})*+(?:\.\d+)?"


def number_tokens(text: Column) -> Column:
    """The numbers of a token, separators within them dropped ("128, 400" is one number)."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({LONG_NUMBERS})"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?<=\d)[,\s]+(?=\d)", ""))


def single_number(text: Column) -> Column:
    """A token's number if it has just one."""
    found = number_tokens(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).try_cast("double"))


def nearest_below(headers: DataFrame, tokens: DataFrame, within: float = SAME_COLUMN) -> DataFrame:
    """headers with value and value_pos: the first token below a header on its page, in its column, with one number.

    A range join: columns are told by the centres, cut into strips as wide as the tolerance; a header looks into its own
    strip and those beside it. Tokens without a place match nothing. The first read of equally near ones is taken.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    a = headers.withColumns({"_x": centre, "_strip": F.explode(F.array(*[F.floor(centre / within) + i for i in (-1, 0, 1)]))})
    values = tokens.select("doc", "page", F.col("pos").alias("_pos"), centre.alias("_tx"), F.col("y0").alias("_ty"), single_number(F.col("text")).alias("_value"), F.floor(centre / within).alias("_strip")).where("_value IS NOT NULL AND _ty IS NOT NULL")
    met = a.join(values, ["doc", "page", "_strip"]).where((F.col("_ty") > F.col("y0")) & (F.abs(F.col("_tx") - F.col("_x")) <= within))
    best = met.groupBy("doc", "pos").agg(F.min_by(F.struct(F.col("_value").alias("value"), F.col("_pos").alias("value_pos")), F.struct(F.col("_ty") - F.col("y0"), "_pos")).alias("v"))
    return headers.join(best, ["doc", "pos"], "left").select(*headers.columns, "v.value", "v.value_pos")


def next_number(tokens: DataFrame, is_label: Column, ahead: int = AHEAD) -> DataFrame:
    """Label tokens with value: their own single number, else the first single number among the next five tokens."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, ahead)
    own = single_number(F.col("text"))
    return tokens.withColumn("_own", own).withColumn("value", F.coalesce("_own", F.first("_own", True).over(w))).where(is_label).drop("_own")
