"""Bills whose figures have to add up: values beside their labels, identities between them, misread digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 48

# Labels by kind of document, and how an account of waste splits by treatment.
LABELS = {
    "kepco_bill": ["기본요금", "전력량요금", "기후환경요금", "연료비조정요금", "전기요금계", "부가가치세", "전력산업기반기금", "청구금액"],
    "gas_bill": ["기본요금", "사용요금", "공급가액 계", "부가가치세", "청구금액"],
    "waste_ledger": ["폐기물 총배출량", "재활용량", "재활용 비율", "소각·매립 비율"],
}
SPLIT, PARTS = r"재활용\s*([\d,]+)\s*kg\s*/\s*소각\s*([\d,]+)\s*kg\s*/\s*매립\s*([\d,]+)\s*kg", ["_재활용", "_소각", "_매립"]
Rule = tuple[str, str, str, Callable[[Callable[[str], Column]], Column], float, bool]
# Fixed values: (rule, document, figure checked, what it should be, how far it may be off, whether tens are cut down to).
RULES: list[Rule] = [
    ("kepco.subtotal", "kepco_bill", "전기요금계", lambda v: v("기본요금") + v("전력량요금") + v("기후환경요금") + v("연료비조정요금"), 1.0, False),
    ("kepco.vat", "kepco_bill", "부가가치세", lambda v: v("전기요금계") * 0.10, 1.0, False),
    ("kepco.fund", "kepco_bill", "전력산업기반기금", lambda v: v("전기요금계") * 0.037, 1.0, True),
    ("kepco.total", "kepco_bill", "청구금액", lambda v: v("전기요금계") + v("부가가치세") + v("전력산업기반기금"), 1.0, True),
    ("gas.supply_total", "gas_bill", "공급가액 계", lambda v: v("기본요금") + v("사용요금"), 1.0, False),
    ("gas.vat", "gas_bill", "부가가치세", lambda v: v("공급가액 계") * 0.10, 1.0, False),
    ("gas.total", "gas_bill", "청구금액", lambda v: v("공급가액 계") + v("부가가치세"), 1.0, True),
    ("waste.method_split", "waste_ledger", "폐기물 총배출량", lambda v: v("_재활용") + v("_소각") + v("_매립"), 1.0, False),
    ("waste.recycle_rate", "waste_ledger", "재활용 비율", lambda v: F.try_divide(v("재활용량"), v("폐기물 총배출량")) * 100.0, 0.1, False),
    ("waste.disposal_complement", "waste_ledger", "소각·매립 비율", lambda v: 100.0 - v("재활용 비율"), 0.1, False),
]
POWERS = [10.0, 100.0, 1000.0, 0.1, 0.01, 0.001]


def value_after(text: Column, label: str) -> Column:
    """The first number within 48 characters after the label's first place, what is in parentheses left out."""
    bare = F.regexp_replace(text, r"\([^)]*\)", " ")
    at = F.instr(bare, F.lit(label))
    found = F.regexp_extract(F.substr(bare, at + len(label), F.lit(NEAR)), r"(\d[\d,]*\.?\d*)", 1)
    return F.when((at > 0) & (found != ""), F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def misread_digits(observed: Column, expected: Column) -> Column:
    """Whether a power of ten, one to three places either way, explains the difference within one per cent."""
    return (observed != 0) & (expected != 0) & F.exists(F.array(*map(F.lit, POWERS)), lambda k: F.abs(expected / observed - k) / k <= 0.01)


def consistency(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(id, rule, severity, expected, observed, residual, suggested_fix): each identity of each document of its kind.

    documents has id, doc_type and text. ok and fail by the rule's tolerance; skipped where a figure isn't there. A fix
    is suggested where digits were misread. Documents of other kinds, and null texts, have only skipped rules or none.
    """
    rows = documents.select("id", "doc_type", F.coalesce("text", F.lit("")).alias("text"))
    labels = sorted({label for found in LABELS.values() for label in found})
    split = [F.replace(F.regexp_extract("text", SPLIT, i + 1), F.lit(","), F.lit("")).try_cast("double").alias(p) for i, p in enumerate(PARTS)]
    rows = rows.select("id", "doc_type", *[value_after(F.col("text"), label).alias(label) for label in labels], *split)
    made = []
    for rule, kind, output, compute, tolerance, tens in rules:
        value = compute(lambda k: F.col(f"`{k}`"))
        value = F.floor(value / 10.0) * 10.0 if tens else value
        made.append(F.when(F.col("doc_type") == kind, F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("expected"), F.col(f"`{output}`").alias("observed"), F.lit(tolerance).alias("tolerance"))))
    rows = rows.select("id", F.explode(F.array_compact(F.array(*made))).alias("x")).select("id", "x.*")
    off = F.abs(F.col("expected") - F.col("observed"))
    severity = F.when(off.isNull(), "skipped").when(off <= F.col("tolerance"), "ok").otherwise("fail")
    fix = F.when((F.col("severity") == "fail") & misread_digits(F.col("observed"), F.col("expected")), F.col("expected"))
    return rows.withColumn("severity", severity).select("id", "rule", "severity", "expected", "observed", F.round(off, 4).alias("residual"), fix.alias("suggested_fix"))


def corrected(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """metrics (id, value, confidence, ...) with the failed figures put right where a fix is known, else believed by 0.3 at most."""
    bad = findings.where("severity = 'fail'").groupBy("id", F.col("observed").alias("value")).agg(F.min("suggested_fix").alias("_fix"), F.lit(True).alias("_bad"))
    met = metrics.join(bad, ["id", "value"], "left")
    doubt = F.col("_bad") & F.col("_fix").isNull()
    return met.withColumns({"value": F.coalesce("_fix", "value"), "confidence": F.when(doubt, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence"))}).drop("_fix", "_bad")
