"""Orders as bills and as tokens on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bills, layout
from ..operators.bills import LABELS, POWERS
from .registry import query, table
from .tables import numbered_lines

# Electricity bills: every seventh total has a digit too many, every fifth tax is off, every eleventh fund is missing.
BILLS_SQL = """
    b AS (SELECT o_orderkey AS id, o_orderkey % 4 = 3 AS gas, 6656000 + o_custkey AS a, CAST(floor(o_totalprice) AS BIGINT) AS e, o_orderkey % 1000 AS c, o_custkey % 100 AS d FROM orders),
    s AS (SELECT *, a + e + c + d AS sub FROM b),
    t AS (SELECT *, CAST(floor(sub * 0.1) AS BIGINT) + CASE WHEN id % 5 = 0 THEN 50 ELSE 0 END AS vat, CAST(floor(sub * 0.037 / 10) AS BIGINT) * 10 AS fund FROM s),
    u AS (SELECT *, ((sub + vat + fund) // 10) * 10 * CASE WHEN id % 7 = 0 THEN 10 ELSE 1 END AS total, ((sub + vat) // 10) * 10 AS gas_total FROM t),
    bills AS (SELECT id, CASE WHEN gas THEN 'gas_bill' ELSE 'kepco_bill' END AS doc_type, CASE WHEN gas THEN '기본요금 ' || format('{:,}', a) || ' 사용요금 ' || format('{:,}', e + c + d) || ' 공급가액 계 ' || format('{:,}', sub) || ' 부가가치세 ' || format('{:,}', vat) || ' 청구금액 ' || format('{:,}', gas_total)
        ELSE '기본요금 (800kW × 8,320원) ' || format('{:,}', a) || ' 전력량요금 ' || format('{:,}', e) || ' 기후환경요금 ' || c || ' 연료비조정요금 ' || d || ' 전기요금계 ' || format('{:,}', sub) || ' 부가가치세 ' || format('{:,}', vat) || CASE WHEN id % 11 = 0 THEN '' ELSE ' 전력산업기반기금 ' || format('{:,}', fund) END || ' 청구금액 ' || format('{:,}', total) || ' 원' END AS text FROM u)"""


def paper_bills(spark, d):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(o.alias("id"), (o % 4 == 3).alias("gas"), (k + 6656000).alias("a"), F.floor("o_totalprice").alias("e"), (o % 1000).alias("c"), (k % 100).alias("d"))
    rows = rows.withColumn("sub", F.expr("a + e + c + d"))
    rows = rows.withColumns({"vat": F.expr("floor(sub * 0.1) + CASE WHEN id % 5 = 0 THEN 50 ELSE 0 END"), "fund": F.expr("floor(sub * 0.037 / 10) * 10")})
    rows = rows.withColumns({"total": F.expr("(sub + vat + fund) div 10 * 10 * CASE WHEN id % 7 = 0 THEN 10 ELSE 1 END"), "gas_total": F.expr("(sub + vat) div 10 * 10")})
    n = lambda c: F.format_number(F.expr(c), 0)
    gas = F.concat(F.lit("기본요금 "), n("a"), F.lit(" 사용요금 "), n("e + c + d"), F.lit(" 공급가액 계 "), n("sub"), F.lit(" 부가가치세 "), n("vat"), F.lit(" 청구금액 "), n("gas_total"))
    fund = F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit(" 전력산업기반기금 "), n("fund")))
    power = F.concat(F.lit("기본요금 (800kW × 8,320원) "), n("a"), F.lit(" 전력량요금 "), n("e"), F.lit(" 기후환경요금 "), F.col("c"), F.lit(" 연료비조정요금 "), F.col("d"), F.lit(" 전기요금계 "), n("sub"), F.lit(" 부가가치세 "), n("vat"), fund, F.lit(" 청구금액 "), n("total"), F.lit(" 원"))
    return rows.select("id", F.when(F.col("gas"), "gas_bill").otherwise("kepco_bill").alias("doc_type"), F.when(F.col("gas"), gas).otherwise(power).alias("text"))


def _value_sql(label: str) -> str:
    return f"CASE WHEN contains(t, '{label}') THEN TRY_CAST(replace(regexp_extract(substr(t, position('{label}' IN t) + {len(label)}, 48), '\\d[\\d,]*\\.?\\d*'), ',', '') AS DOUBLE) END"


NAMES = {label: f"v{i}" for i, label in enumerate(sorted({x for xs in LABELS.values() for x in xs}))}
V = lambda label: NAMES[label]
RULES_SQL = " UNION ALL ".join(
    f"SELECT id, '{rule}' AS rule, {expected} AS expected, {V(out)} AS observed FROM vals WHERE doc_type = '{kind}'"
    for rule, kind, out, expected in (
        ("kepco.subtotal", "kepco_bill", "전기요금계", f"{V('기본요금')} + {V('전력량요금')} + {V('기후환경요금')} + {V('연료비조정요금')}"), ("kepco.vat", "kepco_bill", "부가가치세", f"{V('전기요금계')} * 0.1::DOUBLE"),
        ("kepco.fund", "kepco_bill", "전력산업기반기금", f"floor({V('전기요금계')} * 0.037::DOUBLE / 10) * 10"), ("kepco.total", "kepco_bill", "청구금액", f"floor(({V('전기요금계')} + {V('부가가치세')} + {V('전력산업기반기금')}) / 10) * 10"),
        ("gas.supply_total", "gas_bill", "공급가액 계", f"{V('기본요금')} + {V('사용요금')}"), ("gas.vat", "gas_bill", "부가가치세", f"{V('공급가액 계')} * 0.1::DOUBLE"), ("gas.total", "gas_bill", "청구금액", f"floor(({V('공급가액 계')} + {V('부가가치세')}) / 10) * 10"),
    )
)


@query(rf"""WITH {BILLS_SQL}, bare AS (SELECT id, doc_type, regexp_replace(text, '\([^)]*\)', ' ', 'g') AS t FROM bills), vals AS (SELECT id, doc_type, {', '.join(f'{_value_sql(k)} AS {v}' for k, v in NAMES.items())} FROM bare), r AS ({RULES_SQL}),
    f AS (SELECT *, CASE WHEN expected IS NULL OR observed IS NULL THEN 'skipped' WHEN abs(expected - observed) <= 1 THEN 'ok' ELSE 'fail' END AS severity FROM r)
    SELECT id, rule, severity, round(abs(expected - observed), 4) AS residual, CASE WHEN severity = 'fail' AND ({' OR '.join(f'abs(expected / observed - {k}::DOUBLE) / {k}::DOUBLE <= 0.01' for k in POWERS)}) THEN expected END AS suggested_fix FROM f""")
def bill_identities(spark, d):
    """Sums and shares within each bill, and figures with a misread digit."""
    return bills.consistency(paper_bills(spark, d)).select("id", "rule", "severity", "residual", "suggested_fix")


# Each order a page with two headed columns; some tokens split a number by ", ", some hold two numbers.
TOKENS_SQL = """
    l AS (SELECT l_orderkey AS doc, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
    tokens AS (SELECT DISTINCT doc, 0 AS pos, '수량(kg)' AS text, 0.30::DOUBLE AS x, 0.05::DOUBLE AS y FROM l UNION ALL SELECT DISTINCT doc, 1, '금액(원)', 0.60, 0.05 FROM l
        UNION ALL SELECT doc, 2 * k, CASE WHEN p % 4 = 0 THEN q || ' / ' || p ELSE q::VARCHAR END, 0.30 + (p % 10) * 0.01, 0.05 + k * 0.02 FROM l
        UNION ALL SELECT doc, 2 * k + 1, CASE WHEN p % 3 = 0 THEN replace(format('{:,}', m), ',', ', ') WHEN p % 3 = 1 THEN format('{:,}', m) ELSE '비고' END, 0.60 - (p % 8) * 0.01, 0.05 + k * 0.02 FROM l)"""


def tokens(spark, d):
    p, k = F.col("p"), F.col("k")
    lines = numbered_lines(spark, d)

    def token(pos, text, x, y):
        return F.struct(pos.cast("int").alias("pos"), text.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    lit = F.lit
    heads = lines.select("o").distinct().select("o", F.explode(F.array(token(lit(0), lit("수량(kg)"), lit(0.30), lit(0.05)), token(lit(1), lit("금액(원)"), lit(0.60), lit(0.05)))).alias("t"))
    count = F.when(p % 4 == 0, F.concat("q", lit(" / "), "p")).otherwise(F.col("q").cast("string"))
    money = F.when(p % 3 == 0, F.replace(F.format_number("m", 0), lit(","), lit(", "))).when(p % 3 == 1, F.format_number("m", 0)).otherwise("비고")
    y = lit(0.05) + k * 0.02
    body = lines.select("o", F.explode(F.array(token(2 * k, count, lit(0.30) + (p % 10) * 0.01, y), token(2 * k + 1, money, lit(0.60) - (p % 8) * 0.01, y))).alias("t"))
    rows = heads.unionByName(body)
    return rows.select(F.col("o").alias("doc"), lit(1).alias("page"), "t.pos", "t.text", F.col("t.x").alias("x0"), F.col("t.y").alias("y0"), F.col("t.x").alias("x1"), F.col("t.y").alias("y1"))


NUMBER_SQL = rf"CASE WHEN len(regexp_extract_all(text, '{layout.NUMBERS}')) = 1 THEN TRY_CAST(regexp_replace(regexp_extract(text, '{layout.NUMBERS}'), '[,\s]+', '', 'g') AS DOUBLE) END"


@query(f"""WITH {TOKENS_SQL}, v AS (SELECT *, {NUMBER_SQL} AS value FROM tokens), h AS (SELECT * FROM tokens WHERE pos < 2)
    SELECT h.doc, h.text, arg_min(v.value, v.y * 100000 + v.pos) AS value, arg_min(v.pos, v.y * 100000 + v.pos) AS value_pos FROM h LEFT JOIN v ON v.doc = h.doc AND v.y > h.y AND abs(v.x - h.x) <= 0.06 AND v.value IS NOT NULL GROUP BY h.doc, h.text""")
def column_value_below(spark, d):
    """The first number below each header, in its column."""
    t = tokens(spark, d)
    return layout.nearest_below(t.where("pos < 2"), t).select("doc", "text", "value", F.col("value_pos").cast("long").alias("value_pos"))


@query(f"""WITH {TOKENS_SQL}, v AS (SELECT *, {NUMBER_SQL} AS own FROM tokens), w AS (SELECT *, list(own) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM v)
    SELECT doc, text, coalesce(own, list_filter(ahead, lambda x: x IS NOT NULL)[1]) AS value FROM w WHERE pos < 2""")
def label_next_number(spark, d):
    """The first single number among the five tokens after each label."""
    return layout.next_number(tokens(spark, d), F.col("pos") < 2).select("doc", "text", "value")
