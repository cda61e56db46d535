"""How near texts are to the chunks retrieved for them, and to their company's own texts, by hashed vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import bucket, word_pairs

#: Texts of a company that stand for it.
NEAREST = 5


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed(text: Column, tokens: Callable[[Column], Column] = word_pairs) -> Column:
    """struct<counts: map<bucket, n>, norm>: the bag of a text's terms by bucket; null and empty texts have none."""
    def counted(b: Column) -> Column:
        n = F.transform(F.array_distinct(b), lambda x: F.struct(x.alias("bucket"), (F.size(b) - F.size(F.array_remove(b, x))).cast("double").alias("n")))
        return _bound(n, lambda c: F.struct(F.map_from_entries(c).alias("counts"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["n"] * x["n"])).alias("norm")))

    return _bound(F.transform(tokens(F.coalesce(text, F.lit(""))), bucket), counted)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.map_entries(a["counts"]), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(b["counts"], x["key"]), F.lit(0.0)))
    return F.round(F.coalesce(F.try_divide(dot, a["norm"] * b["norm"]), F.lit(0.0)), 6)


def retrieved_similarity(sentences: DataFrame, chunks: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, sim): of each sentence (by, keys, text) the largest cosine to the chunks (keys, text) retrieved for its key.

    Retrieval leaves a bounded number of chunks a key, so the join has so many rows a sentence. Sentences whose key has no chunk have no row.
    """
    a = sentences.select(*by, *keys, hashed(F.col("text")).alias("_a"))
    met = a.join(chunks.select(*keys, hashed(F.col("text")).alias("_b")), keys)
    return met.groupBy(*by).agg(F.max(cosine(F.col("_a"), F.col("_b"))).alias("sim"))


def mean_similarity(texts: DataFrame, references: DataFrame, keys: list[str], id_col: str = "id", nearest: int = NEAREST) -> DataFrame:
    """(id, sim): the mean cosine of each text (id, keys, text) to the nearest references (keys, text) of its key; 0 without any.

    Texts meet the references of their own company only.
    """
    a = texts.select(id_col, *keys, hashed(F.col("text")).alias("_a"))
    met = a.join(references.select(*keys, hashed(F.col("text")).alias("_b")), keys, "left")
    scored = met.select(id_col, F.when(F.col("_b").isNull(), 0.0).otherwise(cosine(F.col("_a"), F.col("_b"))).alias("s"))
    near = scored.withColumn("_rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("s")))).where(F.col("_rank") <= nearest)
    return near.groupBy(id_col).agg(F.round(F.avg("s"), 6).alias("sim"))
