"""Labelled cases made from figures by controlled corruption, and how well a gate tells them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import prf

KINDS = ("faithful", "numeric", "citation", "unit")
#: Units that a corrupted unit is drawn from.
UNITS = ["TJ", "kWh", "톤", "%", "명", "원"]


def _shown(value: Column, whole: Column) -> Column:
    """Whole numbers with separators, others with up to three digits."""
    digits = F.regexp_replace(F.regexp_replace(F.format_number(value, 3), "0+$", ""), "\\.$", "")
    return F.when(whole, F.format_number(value.cast("long"), 0)).otherwise(digits)


def _moved(value: Column, whole: Column) -> Column:
    """A whole number by one, another by a tenth below ten and by a twentieth, one at least, above."""
    return F.when(whole, value + 1).otherwise(value + F.when(F.abs(value) < 10, 0.1).otherwise(F.greatest(F.abs(value) * 0.05, F.lit(1.0))))


def grounding_cases(facts: DataFrame, kinds: tuple[str, ...] = KINDS, seed: int = 42) -> DataFrame:
    """(case_id, kind, chunk_id, chunk, answer, faithful, hallucinated, uncited): for each fact (fact_id, chunk_id, code, note, value, whole, unit) an answer that
    its chunk supports, one whose number is off, one without its citation, and one whose unit is another.

    Where a choice is free (the other unit) it hangs on a hash of seed, fact and slot, so the rows are the same on any partitioning. Facts without a value have no cases.
    """
    if set(kinds) - set(KINDS):
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    whole, unit = F.coalesce("whole", F.lit(False)), F.coalesce(F.trim("unit"), F.lit(""))
    others = F.filter(F.array(*map(F.lit, UNITS)), lambda u: u != unit)
    slot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "fact_id", F.lit("unit")).cast("binary")), 1, 8), 16, 10).cast("long")
    note, right, wrong = F.trim(F.coalesce("note", F.lit(""))), _shown(F.col("value"), whole), _shown(_moved(F.col("value"), whole), whole)
    spaced = lambda u: F.when(u == "", "").otherwise(F.concat(F.lit(" "), u))
    said = lambda number, u: F.concat(note, F.lit("은 "), number, spaced(u), F.lit("입니다"))
    cited = F.concat(F.lit(" ["), "chunk_id", F.lit("]"))
    none = F.array().cast("array<string>")
    case = lambda kind, answer, faithful, numbers, uncited: F.struct(F.lit(kind).alias("kind"), answer.alias("answer"), F.lit(faithful).alias("faithful"), numbers.alias("hallucinated"), F.lit(uncited).alias("uncited"))
    made = {
        "faithful": case("faithful", F.concat(said(right, unit), cited), True, none, False), "numeric": case("numeric", F.concat(said(wrong, unit), cited), False, F.array(F.replace(wrong, F.lit(","), F.lit(""))), False),
        "citation": case("citation", said(right, unit), False, none, True), "unit": case("unit", F.concat(said(right, F.get(others, slot % F.size(others))), cited), False, none, False),
    }
    chunk = F.trim(F.concat(F.lit("[DART/"), "code", F.lit("] "), note, F.lit(" 수치: "), right, F.lit(" "), unit))
    rows = facts.where("value IS NOT NULL").select("fact_id", "chunk_id", chunk.alias("chunk"), F.explode(F.array(*[made[k] for k in kinds])).alias("c"))
    return rows.select(F.concat_ws(":", "fact_id", "c.kind").alias("case_id"), "c.kind", "chunk_id", "chunk", "c.answer", "c.faithful", "c.hallucinated", "c.uncited")


def grounding_summary(cases: DataFrame, gated: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of "faithful" (what the gate accepts), the share of cases whose invented numbers are told exactly, that of
    uncited claims told, and that of answers not accepted. gated: case_id, decision, orphan_numbers, uncited.
    """
    met = cases.join(gated, "case_id").select("faithful", (F.col("decision") == "ACCEPT").alias("accepted"), (F.array_sort(F.array_distinct("hallucinated")) == F.array_sort(F.array_distinct("orphan_numbers"))).alias("exact"), (cases["uncited"] == (gated["uncited"] > 0)).alias("told"))
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    got = met.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("faithful") == F.col("accepted")).alias("faithfulness_accuracy"), F.count_if(F.col("faithful") & F.col("accepted")).alias("tp"), F.count_if(~F.col("faithful") & F.col("accepted")).alias("fp"),
        F.count_if(F.col("faithful") & ~F.col("accepted")).alias("fn"), share(F.col("exact")).alias("hallucination_exact_match"), share(F.col("told")).alias("uncited_accuracy"), share(~F.col("accepted")).alias("abstention_rate"),
    )
    return got.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).drop("tp", "fp", "fn")


def disclosure_cases(specs: DataFrame, sensitive: list[str], context: dict[str, list[str]]) -> DataFrame:
    """specs (case_id, omit, orphans) with disclosed and missing, both sorted: all sensitive items but those omitted are shown; each orphan ratio in
    turn is shown and what it needs is taken away. A fold over the orphans, as a later one may show again what an earlier one took.
    """
    needs = F.create_map(*[x for r, c in context.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    none = F.array().cast("array<string>")
    omit = F.coalesce("omit", none)
    first = F.struct(F.array_except(F.array(*map(F.lit, sensitive)), omit).alias("shown"), F.array_distinct(omit).alias("gone"))

    def step(a: Column, r: Column) -> Column:
        lost = F.coalesce(F.try_element_at(needs, r), none)
        return F.struct(F.array_except(F.array_union(a["shown"], F.array(r)), lost).alias("shown"), F.array_union(a["gone"], lost).alias("gone"))

    folded = specs.withColumn("_x", F.aggregate(F.coalesce("orphans", none), first, step))
    return folded.select(*specs.columns, F.array_sort("_x.shown").alias("disclosed"), F.array_sort("_x.gone").alias("missing"))
