"""Whether the claims of an answer are grounded in the chunks it cites: citations, numbers, units, strong words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, sentences
from ..functions.lexicon import OVERCLAIMS, PERFECT


def overclaims(text: Column) -> Column:
    """The strong phrases in a text, "100 % ..." ones as written."""
    listed = F.filter(F.array(*map(F.lit, OVERCLAIMS)), lambda p: F.contains(text, p))
    return F.concat(listed, F.regexp_extract_all(text, F.lit(rf"(100\s*%\s*(?:{'|'.join(PERFECT)}))"), F.lit(1)))


def chunk_facts(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, facts): what an answer is held against, so that no chunk's text is shuffled. A chunk repeated counts once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = F.struct(numbers.number_unit_pairs(text).alias("pairs"), numbers.number_values(text).alias("values"), overclaims(text).alias("strong"))
    return chunks.where(F.col(id_col) != "").select(F.col(id_col).alias("chunk_id"), facts.alias("facts")).groupBy("chunk_id").agg(F.first("facts").alias("facts"))


def grounding(answers: DataFrame, chunks: DataFrame, id_col: str = "answer_id", text_col: str = "text") -> DataFrame:
    """One row an answer: decision, hard_fails, soft_flags, faithfulness and what led to them.

    A claim without a citation is uncited (G1). A number with a unit is grounded by a pair of a cited chunk in units
    that compare, one per cent apart at most; else an equal value in other units is a mismatch (G4). Numbers left are
    orphans unless a cited chunk has them in any unit (G2). Strong words that no cited chunk has are an overclaim (G5),
    a soft flag. Faithfulness is the share of claims whose citations name a known chunk, 1 without claims. Answers
    with null or empty text have no claims; a citation of an unknown chunk grounds nothing.
    """
    rows = answers.select(F.col(id_col).alias("answer"), F.posexplode_outer(sentences.cited_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line", "s"))
    claims = rows.select("answer", "line", F.col("s.clean").alias("clean"), F.col("s.cited").alias("cited")).where("clean IS NULL OR length(clean) >= 6")
    cited = claims.select("answer", "line", F.explode(F.array_distinct("cited")).alias("chunk_id")).join(chunk_facts(chunks), "chunk_id")
    held = cited.groupBy("answer", "line").agg(F.collect_list("facts").alias("facts"))
    met = claims.join(held, ["answer", "line"], "left")
    has = F.size(F.coalesce("facts", F.array())) > 0
    met = met.withColumns({k: F.when(has, F.flatten(F.col("facts")[k])) for k in ("pairs", "values", "strong")})

    def any_of(array: str, test) -> Column:
        return F.coalesce(F.exists(array, test), F.lit(False))

    def told(p: Column) -> Column:
        grounded = any_of("pairs", lambda c: (c["kind"] == p["kind"]) & numbers.close(c["base"], p["base"]))
        apart = any_of("pairs", lambda c: (c["kind"] != p["kind"]) & numbers.close(c["value"], p["value"]))
        first = F.get(F.filter("pairs", lambda c: (c["kind"] != p["kind"]) & numbers.close(c["value"], p["value"])), F.lit(0))
        note = F.concat(numbers.plain(p["value"]), F.lit(" "), p["unit"], F.lit(" ↔ "), numbers.plain(first["value"]), F.lit(" "), first["unit"])
        return F.struct(numbers.plain(p["value"]).alias("number"), F.when(grounded, "grounded").when(apart, "mismatch").otherwise("none").alias("how"), F.when(~grounded & apart, note).alias("note"))

    claim = sentences.is_claim(F.col("clean"))
    linked = F.size("cited") > 0
    met = met.withColumns({"claim": F.coalesce(claim, F.lit(False)), "linked": F.coalesce(linked, F.lit(False)), "told": F.transform(numbers.number_unit_pairs(F.coalesce("clean", F.lit(""))), told)})
    known = F.transform(F.filter("told", lambda x: x["how"] != "none"), lambda x: x["number"])
    orphans = F.filter(F.array_except(numbers.number_tokens(F.coalesce("clean", F.lit(""))), known), lambda n: ~any_of("values", lambda v: numbers.close(v, numbers.bare_number(n))))
    over = F.size(F.array_except(overclaims(F.coalesce("clean", F.lit(""))), F.coalesce("strong", F.array().cast("array<string>")))) > 0
    checked = met.select(
        "answer", "line", "claim", (F.col("claim") & ~F.col("linked")).alias("uncited"), (F.col("claim") & F.col("pairs").isNotNull()).alias("supported"),
        F.when(F.col("claim") & F.col("linked"), orphans).alias("orphans"), F.when(F.col("claim") & F.col("linked"), F.filter(F.transform("told", lambda x: x["note"]), lambda x: x.isNotNull())).alias("mismatches"),
        (F.col("claim") & F.col("linked") & over).alias("over"),
    )
    none = F.array().cast("array<string>")

    def in_order(column: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce(column, none).alias("x")))), lambda s: s["x"])))

    out = checked.groupBy("answer").agg(
        F.count_if("claim").alias("claims"), F.count_if("uncited").alias("uncited"), F.count_if("supported").alias("supported"), in_order("orphans").alias("orphan_numbers"), in_order("mismatches").alias("unit_mismatches"), F.bool_or("over").alias("overclaim"),
    )
    hard = F.array_compact(F.array(F.when(F.col("uncited") > 0, "G1_uncited_claims"), F.when(F.size("orphan_numbers") > 0, "G2_orphan_numbers"), F.when(F.size("unit_mismatches") > 0, "G4_unit_mismatch")))
    return out.select(
        F.col("answer").alias(id_col), F.when(F.size(hard) == 0, "ACCEPT").otherwise("ESCALATE").alias("decision"), hard.alias("hard_fails"), F.when(F.col("overclaim"), F.array(F.lit("G5_overclaim"))).otherwise(none).alias("soft_flags"),
        "uncited", "orphan_numbers", "unit_mismatches", F.round(F.when(F.col("claims") == 0, 1.0).otherwise(F.col("supported") / F.col("claims")), 4).alias("faithfulness"),
    )
