"""Filings of suppliers by year, and the figures that ordered rules read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction
from .registry import query, table
from .statements import SERIES_SQL, figures

# Each filing is made of parts that its supplier and year choose, so that every rule, and what goes before it, is met.
PARTS = [
    ["온실가스 배출은 {q} tCO2eq였다. ", "배출량 추정치 (단위: 만톤(tCO2-eq)) {n} ", "탄소배출 합계 없음. 총 {q} TCO2EQ. ", "{n} 만톤 CO2 배출, ", "배출량 없음. ", "온실가스 1.2.3 tCO2, {q} tCO2eq "],
    ["전력 사용량 {q} kWh. ", "총 에너지 {n} TJ, 그 밖에 {q}kWh. ", "에너지 {n} kwh ", "재생 에너지 비율 {x} %. "],
    ["폐기물 발생 {n} 톤, 매립 {q} 톤. ", "소각 {n} ton. ", "취수량 {q} 톤. ", "용수 사용 {q} m³, 취수량 {n} 톤. ", "재해율 {x}% ", "사고 건수 {k} 건. "],
    ["사외이사 {k} 인, 사내이사 2명. ", "이사의 수 사외이사 수 변동 5 {k} - ", "이사회는 총 7명, {k}인의 사외이사. ", "사외이사 4 인. ", "이사의 수 사외이사 수 2 9, 3명의 사내이사와 사외이사 1 명. ", "현금배당성향(%) {x} "],
    ["여성 이사 {x}%. 출석률: {x}%. ", "여성 임원 {k}명. 이사회 안건 처리 {n}건. ", "주주총회 소집 공고 {k}일 전. ", "공정거래 위반 {k} 건. "],
    ["신규 채용 인원은 {n}명, 신규채용 {q}명. ", "이직률은 {x}%, 자발적 이직 {n} 명. ", "교육훈련비 {n}만 원. ", "복리후생비 {n} 억 원, 1인당 교육비 {q} 천원. ", "개인정보 유출 건수는 {k}건. ", "정규직 비율 {x}%, 비정규직 {n}명. 퇴직 , 명. ", "노조 가입률 : {x}% 여성 급여 비율 {x}%. ", "LTIFR {x}%. 사회 법규 위반 {k}건. 복리후생비 {q}원. "],
    ["", "직원 등의 현황 --- 12 직원 등의 현황 표 합 계 {q} - 1,200 - {s} 9.5 성별합계 남 10 - 2 - {n} 성별합계 여 10 - 2 - {q} 미등기임원 보수 성별합계 여 1 - 1 - 999,999 ", "직원현황 사무직 남 5 - 1 - {q} 생산부문 남 5 - 1 - {n} 사무직 여 5 - 1 - {n} ", "직원 등 현황 합 계 90 - 1 - 95 3.2 성별합계 남 1 - 1 - 60 성별합계 여 1 - 1 - 40 "],
]
SEEDS = (1, 3, 7, 11, 13, 17, 19)


def _pick_sql(options: list[str], seed: int) -> str:
    text = "list_extract([" + ", ".join(f"'{o}'" for o in options) + f"], 1 + (corp * {seed} + period) % {len(options)})"
    for name, value in (("q", "format('{:,}', q)"), ("n", "n::VARCHAR"), ("k", "(corp % 5 + 1)::VARCHAR"), ("x", "((q % 900) // 10)::VARCHAR || '.' || (q % 10)"), ("s", "format('{:,}', q + 1500)")):
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


FILINGS_SQL = f"f AS ({SERIES_SQL}), texts AS (SELECT corp * 10000 + period AS id, corp, period, {' || '.join(_pick_sql(o, s) for o, s in zip(PARTS, SEEDS))} AS text FROM f)"


def filings(spark, d):
    """(id, corp, period, text)."""
    f = figures(spark, d)
    values = {"q": F.format_number("q", 0), "n": F.col("n").cast("string"), "k": (F.col("corp") % 5 + 1).cast("string"), "x": F.concat(F.floor(F.col("q") % 900 / 10), F.lit("."), F.col("q") % 10), "s": F.format_number(F.col("q") + 1500, 0)}
    parts = []
    for options, seed in zip(PARTS, SEEDS):
        text = F.get(F.array(*map(F.lit, options)), (F.col("corp") * seed + F.col("period")) % len(options))
        for name, value in values.items():
            text = F.replace(text, F.lit(f"{{{name}}}"), value)
        parts.append(text)
    return f.select((F.col("corp") * 10000 + F.col("period")).alias("id"), "corp", "period", F.concat(*parts).alias("text"))


RULES_SQL = "rules(o, code, unit, pattern, factor) AS (VALUES " + ", ".join(f"({i}, '{c}', '{u}', '(?i){p}', {f})" for i, (c, u, p, f) in enumerate(extraction.RULES)) + ")"
_GOT = "nullif(regexp_extract(text, '{p}', {g}), '')::DOUBLE"
BOARD_SQL = f"""b AS (SELECT id, {_GOT.format(p=extraction.BOARD_TABLE, g=1)} AS t1, {_GOT.format(p=extraction.BOARD_TABLE, g=2)} AS o1, coalesce({', '.join(_GOT.format(p=p, g=1) for p in extraction.OUTSIDE)}) AS o2,
        coalesce({', '.join(_GOT.format(p=p, g=1) for p in extraction.TOTALS)}) AS t2, coalesce({_GOT.format(p=extraction.INSIDE, g=1)}, {_GOT.format(p=extraction.INSIDE, g=2)}) AS i2 FROM texts),
    board AS (SELECT id, CASE WHEN t1 >= o1 AND o1 > 0 THEN round(o1 / t1 * 100, 1) WHEN coalesce(t2, o2 + i2) >= o2 AND o2 > 0 THEN round(o2 / coalesce(t2, o2 + i2) * 100, 1) END AS value FROM b)"""


@query(f"""WITH {FILINGS_SQL}, {RULES_SQL}, {BOARD_SQL},
    m AS (SELECT id, code, unit, o, TRY_CAST(replace(regexp_extract(text, pattern, 1), ',', '') AS DOUBLE) * factor AS value FROM texts, rules WHERE regexp_matches(text, pattern))
    SELECT id, code, value, unit, o::INT AS rule FROM m WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, code ORDER BY o) = 1
    UNION ALL SELECT id, 'G-1-2', value, '%', NULL FROM board WHERE value IS NOT NULL""")
def filing_figures(spark, d):
    """The first rule of each code that finds a number in a filing, and the share of outside directors."""
    return extraction.filing_figures(filings(spark, d))


LABELS_SQL = "labels(o, w, code) AS (VALUES " + ", ".join(f"({i}, '{w}', '{c}')" for i, (w, c) in enumerate(extraction.LABELS.items())) + ")"


def _social_sql(i: int, pattern: str, unit: str | None) -> str:
    money = "" if unit else f", unnest(regexp_extract_all(text, '{pattern}', 3)) AS raw"
    factor = "1" if unit else "CASE replace(raw, ' ', '') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in extraction.MONEY.items()) + " END"
    inner = f"SELECT id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS label, unnest(regexp_extract_all(text, '{pattern}', 2)) AS num, generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) AS j{money} FROM texts"
    return f"SELECT id, {i} AS p, j, replace(label, ' ', '') AS label, TRY_CAST(replace(num, ',', '') AS DOUBLE) * {factor} AS value, '{unit or '원'}' AS unit FROM ({inner})"


@query(f"""WITH {FILINGS_SQL}, {LABELS_SQL}, hit AS ({' UNION ALL '.join(_social_sql(i, p, u) for i, (p, u) in enumerate(extraction.SOCIAL))}),
    coded AS (SELECT id, p, j, value, unit, arg_min(code, o) AS code FROM hit JOIN labels ON contains(label, w) OR contains(w, label) WHERE value IS NOT NULL GROUP BY id, p, j, value, unit)
    SELECT id, code, value, unit FROM coded JOIN texts USING (id) WHERE NOT (code = 'S-2-2' AND corp % 2 = 0) QUALIFY row_number() OVER (PARTITION BY id, code ORDER BY p, j) = 1""")
def social_figures(spark, d):
    """Social figures in the sentences of filings; every second supplier's share of regular staff is known already."""
    texts = filings(spark, d)
    known = texts.where("corp % 2 = 0").select("corp", F.lit("S-2-2").alias("code"))
    return extraction.social_figures(texts, known, ["corp"]).select("id", "code", "value", "unit")


def _section_sql(found: str, marker: str) -> str:
    body = f"substr(text, strpos(text, '{found}'))"
    return f"CASE WHEN contains(text, '{found}') AND NOT regexp_matches(substr({body}, {len(marker) + 1}, 80), '-{{3,}}|\\s+\\d{{3}}\\s') THEN {body} END"


# The first heading of a filing that has two is a line of its contents, and the second is followed by the word for a table.
_SECTION = "coalesce(" + ", ".join(_section_sql(f, m) for f, m in zip([extraction.SECTION[0] + " 표", *extraction.SECTION[1:]], extraction.SECTION)) + ")"
_N = "replace({x}, ',', '')::DOUBLE"


@query(f"""WITH {FILINGS_SQL}, s AS (SELECT id, CASE WHEN contains(s, '미등기임원 보수') THEN substr(s, 1, strpos(s, '미등기임원 보수') - 1) ELSE s END AS s FROM (SELECT id, {_SECTION} AS s FROM texts) WHERE s IS NOT NULL),
    n AS (SELECT id, {_N.format(x=f"nullif(regexp_extract(s, '{extraction.ALL_STAFF}', 1), '')")} AS regular, {_N.format(x=f"nullif(regexp_extract(s, '{extraction.ALL_STAFF}', 3), '')")} AS whole,
        coalesce({_N.format(x=f"list_extract(regexp_extract_all(s, '{extraction.BY_SEX.replace('(남|여)', '남')}', 3), -1)")}, 0) AS m1, coalesce({_N.format(x=f"list_extract(regexp_extract_all(s, '{extraction.BY_SEX.replace('(남|여)', '여')}', 3), -1)")}, 0) AS w1,
        coalesce(list_sum(list_transform(regexp_extract_all(s, '{extraction.BY_UNIT.replace('(남|여)', '남')}', 3), lambda x: {_N.format(x='x')})), 0) AS m2, coalesce(list_sum(list_transform(regexp_extract_all(s, '{extraction.BY_UNIT.replace('(남|여)', '여')}', 3), lambda x: {_N.format(x='x')})), 0) AS w2 FROM s),
    g AS (SELECT *, CASE WHEN m1 + w1 = 0 THEN m2 ELSE m1 END AS men, CASE WHEN m1 + w1 = 0 THEN w2 ELSE w1 END AS women FROM n)
    SELECT id, 'S-2-2' AS code, round(regular / whole * 100, 1) AS value FROM g WHERE whole > 100 AND regular <= whole UNION ALL SELECT id, 'S-3-1', round(women / (men + women) * 100, 1) FROM g WHERE men + women > 100""")
def staff_ratios(spark, d):
    """Regular staff and women, from rows of the employees' table in a filing."""
    return extraction.staff_ratios(filings(spark, d))


@query("""WITH r AS (SELECT o_custkey AS corp, CASE o_orderkey % 3 WHEN 0 THEN ' 여' WHEN 1 THEN '남' END AS sex, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 50 END AS staff, o_orderkey % 40 AS regular FROM orders),
    s AS (SELECT corp, coalesce(sum(coalesce(staff, 0)) FILTER (trim(sex) = '여'), 0) AS women, coalesce(sum(coalesce(staff, 0)) FILTER (sex = '남'), 0) AS men, sum(regular) AS regular, sum(coalesce(staff, 0)) AS staff FROM r GROUP BY corp)
    SELECT corp, CASE WHEN women + men > 0 THEN round(women::DOUBLE / (women + men) * 100, 1) END AS female_ratio, CASE WHEN staff > 0 THEN round(regular::DOUBLE / staff * 100, 1) END AS regular_ratio FROM s""")
def employee_stats(spark, d):
    """Shares of women and of regular staff from rows by sex (customers' orders stand for a company's units)."""
    o = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("corp"), F.when(o % 3 == 0, " 여").when(o % 3 == 1, "남").alias("sex"), F.when(o % 7 > 0, o % 50).alias("staff"), (o % 40).alias("regular"))
    return extraction.employee_stats(rows, ["corp"])
