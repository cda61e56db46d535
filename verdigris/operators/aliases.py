"""Labels resolved to codes through aliases: the same, the longest one contained, or the one most like it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units and noise taken out of labels, in this order.
NOISE = ["tco2eq", "tco2", "co2eq", "co2", "kwh", "mwh", "gwh", "kg", "tj", "mj", "㎥", "m3", "ton", "톤", "원", "건", "명", "‰", "pct"]


def normal_label(label: Column) -> Column:
    """Lower case, without what is in parentheses, without anything but digits and letters, without units."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\([^)]*\)", " "), "[^0-9a-z가-힣]+", "")
    for token in NOISE:
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character by itself, none of an empty text."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))
    return F.when(F.char_length(text) >= 2, F.array_distinct(pairs)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """(alias, code, ord) of the normal aliases that one code alone owns; ord, of any kind that sorts, is their first place in the list."""
    named = aliases.select(normal_label(F.col("alias")).alias("alias"), "code", "ord").where("length(alias) >= 2")
    return named.groupBy("alias").agg(F.min("code").alias("code"), F.min("ord").alias("ord"), F.max("code").alias("_last")).where("code = _last").drop("_last")


def resolve(labels: DataFrame, aliases: DataFrame, label_col: str = "label", contained: float = 0.9, least: float = 0.62, gap: float = 0.08, longest_fuzzy: int | None = None) -> DataFrame:
    """labels with code, confidence and method.

    exact: the label is an alias (confidence 1), or holds one (contained; the longest, unless two codes share that
    length). fuzzy: the alias of most common character pairs by Jaccard, at least `least` and `gap` ahead of the
    second. Else none, with the best Jaccard as confidence. Equal labels are resolved once. Labels with no two
    characters left, and null ones, resolve to none.
    """
    index = alias_index(aliases)
    rows = labels.withColumn("_norm", normal_label(F.col(label_col)))
    known = rows.select(F.col("_norm").alias("norm")).where("length(norm) >= 2").distinct()
    exact = known.join(index.select(F.col("alias").alias("norm"), "code"), "norm").select("norm", "code", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    open_ = known.join(index.select(F.col("alias").alias("norm")), "norm", "left_anti")
    # An alias that a label holds begins with a pair of characters that the label has.
    pairs = open_.select("norm", F.explode(bigrams(F.col("norm"))).alias("pair"))
    heads = index.select("alias", "code", F.substr("alias", F.lit(1), F.lit(2)).alias("pair"))
    held = pairs.join(heads, "pair").where(F.contains("norm", F.col("alias"))).groupBy("norm", F.length("alias").alias("size")).agg(F.min("code").alias("code"), F.max("code").alias("other"))
    held = held.groupBy("norm").agg(F.max_by(F.struct("code", "other"), "size").alias("x")).where("x.code = x.other").select("norm", "x.code", F.lit(contained).alias("confidence"), F.lit("exact").alias("method"))
    left = pairs.join(held.select("norm"), "norm", "left_anti")
    sized = index.select("alias", "code", "ord", bigrams(F.col("alias")).alias("b")).select("alias", "code", "ord", F.size("b").alias("m"), F.explode("b").alias("pair"))
    common = left.join(sized, "pair").groupBy("norm", "alias", "code", "ord", "m").agg(F.count(F.lit(1)).alias("both"))
    scored = common.withColumn("s", F.col("both") / (F.size(bigrams(F.col("norm"))) + F.col("m") - F.col("both")))
    order = Window.partitionBy("norm").orderBy(F.desc("s"), "ord", "alias")
    two = scored.withColumn("k", F.row_number().over(order)).where("k <= 2")
    best = two.groupBy("norm").agg(F.min_by("code", "k").alias("code"), F.max("s").alias("s"), F.max(F.when(F.col("k") == 2, F.col("s"))).alias("second"))
    sure = (F.col("s") >= least) & (F.col("s") - F.coalesce("second", F.lit(0.0)) >= gap)
    sure = sure & (F.length("norm") <= longest_fuzzy) if longest_fuzzy else sure
    fuzzy = best.select("norm", F.when(sure, F.col("code")).alias("code"), F.round("s", 3).alias("confidence"), F.when(sure, "fuzzy").otherwise("none").alias("method"))
    found = exact.unionByName(held).unionByName(fuzzy).withColumnRenamed("norm", "_norm")
    return rows.join(found, "_norm", "left").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "method": F.coalesce("method", F.lit("none"))}).drop("_norm")


def backfill(metrics: DataFrame, doc: str = "doc", code: str = "code", resolved: str = "resolved", order: str = "ord") -> DataFrame:
    """metrics whose missing code is filled by the resolved one, if no metric of the document has that code and none
    before it has taken it; fuzzy codes (method) are believed by a half at most (confidence).
    """
    owned = metrics.where(F.col(code).isNotNull()).select(doc, F.col(code).alias("_owned")).distinct()
    wants = metrics.where(F.col(code).isNull() & F.col(resolved).isNotNull()).join(owned, (metrics[doc] == owned[doc]) & (metrics[resolved] == owned["_owned"]), "left_anti")
    first = wants.groupBy(doc, resolved).agg(F.min(order).alias("_first")).withColumnsRenamed({doc: "_doc", resolved: "_resolved"})
    met = metrics.join(first, (F.col(doc) == F.col("_doc")) & (F.col(resolved) == F.col("_resolved")) & (F.col(order) == F.col("_first")) & F.col(code).isNull(), "left")
    takes = F.col("_first").isNotNull()
    unsure = takes & (F.col("method") == "fuzzy")
    return met.withColumns({code: F.when(takes, F.col(resolved)).otherwise(F.col(code)), "confidence": F.when(unsure, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))}).drop("_doc", "_resolved", "_first")
