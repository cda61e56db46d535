"""Labelled cases made from suppliers' figures, what the grounding gate makes of them, and scenarios of selective disclosure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import goldsets, grounding
from ..operators.disclosure import CONTEXT, SENSITIVITY
from .registry import query
from .statements import ANSWERS_SQL, GROUNDING_SQL, SERIES_SQL, figures

_UNITS = ", ".join(f"'{u}'" for u in goldsets.UNITS)
_SHOW = "CASE WHEN whole THEN format('{{:,}}', ({v})::BIGINT) ELSE rtrim(rtrim(format('{{:,}}', floor(round({v}, 3))::BIGINT) || '.' || lpad(((round({v}, 3) - floor(round({v}, 3))) * 1000)::BIGINT::VARCHAR, 3, '0'), '0'), '.') END"
CASES_SQL = f"""
    f AS ({SERIES_SQL}),
    facts AS (SELECT 'f' || corp || '-' || period AS fact_id, 'c' || corp || '-' || period AS chunk_id, 'E-4-2' AS code, '재생에너지 사용량' AS note, q::DOUBLE AS value, true AS whole, 'TJ' AS unit FROM f
        UNION ALL SELECT 'w' || corp || '-' || period, 'd' || corp || '-' || period, 'E-6-1', '폐기물', round(n / 7.0, 3)::DOUBLE, false, CASE WHEN corp % 3 = 0 THEN '' ELSE '톤' END FROM f),
    shown AS (SELECT *, {_SHOW.format(v='value')} AS a, {_SHOW.format(v='CASE WHEN whole THEN value + 1 WHEN abs(value) < 10 THEN value + 0.1::DOUBLE ELSE value + greatest(abs(value) * 0.05::DOUBLE, 1.0::DOUBLE) END')} AS b, list_filter([{_UNITS}], lambda u: u <> unit) AS others, ('0x' || substr(md5('42:' || fact_id || ':unit'), 1, 8))::BIGINT AS slot FROM facts),
    cases AS (SELECT fact_id || ':' || kind AS case_id, kind, chunk_id, trim('[DART/' || code || '] ' || note || ' 수치: ' || a || ' ' || unit) AS chunk,
        note || '은 ' || CASE WHEN kind = 'numeric' THEN b ELSE a END || CASE WHEN u = '' THEN '' ELSE ' ' || u END || '입니다' || CASE WHEN kind = 'citation' THEN '' ELSE ' [' || chunk_id || ']' END AS answer,
        kind = 'faithful' AS faithful, CASE WHEN kind = 'numeric' THEN [replace(b, ',', '')] ELSE [] END AS hallucinated, kind = 'citation' AS uncited
        FROM (SELECT *, CASE WHEN kind = 'unit' THEN others[1 + slot % len(others)] ELSE unit END AS u FROM shown, (VALUES ('faithful'), ('numeric'), ('citation'), ('unit')) k(kind)))"""


def cases(spark, d):
    f = figures(spark, d)
    key = lambda letter: F.concat(F.lit(letter), "corp", F.lit("-"), "period")
    fact = lambda a, b, code, note, value, whole, unit: F.struct(key(a).alias("fact_id"), key(b).alias("chunk_id"), F.lit(code).alias("code"), F.lit(note).alias("note"), value.cast("double").alias("value"), F.lit(whole).alias("whole"), unit.alias("unit"))
    both = F.array(fact("f", "c", "E-4-2", "재생에너지 사용량", F.col("q"), True, F.lit("TJ")), fact("w", "d", "E-6-1", "폐기물", F.round(F.col("n") / 7.0, 3), False, F.when(F.col("corp") % 3 == 0, "").otherwise("톤")))
    return goldsets.grounding_cases(f.select(F.explode(both).alias("x")).select("x.*"))


@query(f"WITH {CASES_SQL} SELECT case_id, chunk, answer, faithful, array_to_string(hallucinated, ',') AS hallucinated, uncited FROM cases")
def grounding_cases(spark, d):
    """Supported answers, and the same with a number, a citation or a unit corrupted."""
    return cases(spark, d).select("case_id", "chunk", "answer", "faithful", F.array_join("hallucinated", ",").alias("hallucinated"), "uncited")


_GATED_SQL = GROUNDING_SQL.replace(ANSWERS_SQL, CASES_SQL + ", answers AS (SELECT case_id AS answer_id, answer AS text FROM cases), chunks AS (SELECT DISTINCT chunk_id, chunk AS text FROM cases)")
_AT = _GATED_SQL.rindex("    SELECT answer_id, CASE WHEN uncited")


@query(f"""WITH {_GATED_SQL[:_AT].rstrip()}, told AS ({_GATED_SQL[_AT:]}),
    m AS (SELECT faithful, decision = 'ACCEPT' AS accepted, list_sort(hallucinated) = list_sort(string_split(orphan_numbers, ',')[(CASE WHEN orphan_numbers = '' THEN 2 ELSE 1 END):]) AS exact, c.uncited = (t.uncited > 0) AS seen FROM cases c JOIN told t ON t.answer_id = c.case_id),
    z AS (SELECT count(*) AS n, round(avg((faithful = accepted)::INT), 4) AS faithfulness_accuracy, count(*) FILTER (faithful AND accepted) AS tp, count(*) FILTER (NOT faithful AND accepted) AS fp, count(*) FILTER (faithful AND NOT accepted) AS fn, round(avg(exact::INT), 4) AS hallucination_exact_match, round(avg(seen::INT), 4) AS uncited_accuracy, round(avg((NOT accepted)::INT), 4) AS abstention_rate FROM m)
    SELECT n, faithfulness_accuracy, hallucination_exact_match, uncited_accuracy, abstention_rate, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM z""")
def grounding_summary(spark, d):
    """How well the grounding gate tells supported answers from corrupted ones."""
    made = cases(spark, d)
    gated = grounding.grounding(made.select(F.col("case_id").alias("answer_id"), F.col("answer").alias("text")), made.select("chunk_id", F.col("chunk").alias("text")))
    return goldsets.grounding_summary(made, gated.withColumnRenamed("answer_id", "case_id"))


_LIST = lambda codes: "[" + ", ".join(f"'{c}'" for c in codes) + "]"
_SENSITIVE, _RATIOS = list(SENSITIVITY), list(CONTEXT)


@query(f"""WITH c AS (SELECT DISTINCT l_suppkey AS corp FROM lineitem), s AS (SELECT corp, list_filter({_LIST(_SENSITIVE)}, lambda x, i: (corp // (1 << (i - 1))) % 2 = 1) AS omit, list_filter({_LIST(_RATIOS)}, lambda x, i: corp % (i + 1) = 0) AS orphans FROM c),
    x AS (SELECT corp, omit, orphans, flatten(list_transform(orphans, lambda r: CASE r {" ".join(f"WHEN '{r}' THEN {_LIST(c)}" for r, c in CONTEXT.items())} END)) AS lost FROM s)
    SELECT corp AS case_id, array_to_string(list_sort(list_filter({_LIST(_SENSITIVE)} || orphans, lambda k: NOT list_contains(lost, k) AND NOT list_contains(omit, k))), ',') AS disclosed, array_to_string(list_sort(list_distinct(omit || lost)), ',') AS missing FROM x""")
def disclosure_scenarios(spark, d):
    """Items that each supplier's scenario shows and leaves out: omissions by the bits of its number, orphan ratios by its divisors."""
    corp = F.col("corp")
    omit = F.array_compact(F.array(*[F.when(F.floor(corp / (1 << i)) % 2 == 1, c) for i, c in enumerate(_SENSITIVE)]))
    orphans = F.array_compact(F.array(*[F.when(corp % (i + 2) == 0, r) for i, r in enumerate(_RATIOS)]))
    specs = figures(spark, d).select("corp").distinct().select(corp.alias("case_id"), omit.alias("omit"), orphans.alias("orphans"))
    return goldsets.disclosure_cases(specs, _SENSITIVE, CONTEXT).select("case_id", F.array_join("disclosed", ",").alias("disclosed"), F.array_join("missing", ",").alias("missing"))
