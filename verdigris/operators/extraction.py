"""Figures read from filings by ordered rules: the first rule of a code that finds a number gives its value.

A text is looked at once: words that every rule needs gate it, rules are expressions over the one column, and what they find is picked
within an array, so nothing is shuffled and no row is made for a text and a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code, unit, pattern and factor of each rule, in the order in which they are tried.
RULES = [
    ("E-3-1", "tCO2eq", r"배출량\s*추정치\s*\([^\)]+\(tCO2[^\)]+\)\s*\)\s*([\d,\.]+)", 10000.0),
    ("E-3-1", "tCO2eq", r"(?:온실가스|GHG|Scope\s*1\s*[\+&]\s*2|탄소배출)[^\d]{0,60}([\d,\.]+)\s*(?:천\s*)?tCO2", 1.0),
    ("E-3-1", "tCO2eq", r"([\d,\.]+)\s*(?:천\s*)?tCO2eq", 1.0),
    ("E-3-1", "tCO2eq", r"([\d,\.]+)\s*만톤\s*(?:CO2|tCO2|\(tCO2)", 10000.0),
    ("E-4-1", "kWh", r"(?:에너지\s*사용|전력\s*사용|전력소비|에너지소비)[^\d]{0,40}([\d,\.]+)\s*(?:천\s*)?(?:kWh|KWh)", 1.0),
    ("E-4-1", "TJ", r"(?:에너지\s*사용|총\s*에너지)[^\d]{0,40}([\d,\.]+)\s*TJ", 1.0),
    ("E-4-1", "kWh", r"([\d,\.]+)\s*(?:천\s*)?kWh", 1.0),
    ("E-5-1", "m³", r"(?:용수\s*사용|취수량|물\s*사용)[^\d]{0,40}([\d,\.]+)\s*(?:천\s*)?m[³3]", 1.0),
    ("E-5-1", "ton", r"(?:용수\s*사용|취수량)[^\d]{0,40}([\d,\.]+)\s*(?:천\s*)?(?:톤|ton)", 1.0),
    ("E-6-1", "ton", r"(?:폐기물\s*발생|총\s*폐기물|폐기물\s*배출)[^\d]{0,40}([\d,\.]+)\s*(?:천\s*)?(?:톤|ton)", 1.0),
    ("E-6-1", "ton", r"(?:매립|소각|재활용)[^\d]{0,40}([\d,\.]+)\s*(?:천\s*)?(?:톤|ton)", 1.0),
    ("E-4-2", "%", r"(?:재생\s*에너지|재생에너지\s*비율|신재생)[^\d]{0,40}([\d,\.]+)\s*%", 1.0),
    ("S-3-1", "%", r"(?:산재율|재해율|사고율)[^\d]{0,30}([\d,\.]+)\s*%", 1.0),
    ("S-3-1", "건", r"(?:산재|재해|사고\s*건수)[^\d]{0,30}([\d,\.]+)\s*건", 1.0),
    ("G-3-4", "%", r"(?:연결)?현금배당성향\s*\(?\s*%?\s*\)?\s*([\d\.]+)", 1.0),
    ("G-1-4", "%", r"여성\s*(?:이사|등기임원)[^\d]{0,60}([\d\.]+)\s*%", 1.0),
    ("G-1-4", "명", r"여성\s*(?:이사|등기임원|임원)[^\d]{0,60}(\d+)\s*(?:인|명)", 1.0),
    ("G-2-1", "%", r"출석률\s*:?\s*([\d\.]+)\s*%", 1.0),
    ("G-2-3", "건", r"(?:이사회\s*)?(?:안건|의안)\s*(?:처리|상정|심의)?\s*(?:건수\s*)?:?\s*(\d+)\s*건", 1.0),
    ("G-3-1", "일", r"(?:주주총회\s*소집\s*공고|소집\s*공고일)[^\d]{0,60}(\d+)\s*일\s*(?:전|이전)", 1.0),
    ("G-6-1", "건", r"(?:법규\s*위반|공정거래\s*위반|과징금\s*부과)[^\d]{0,60}(\d+)\s*건", 1.0),
]
# Words of which each rule needs one.
GATE = r"tCO2|만톤|kWh|TJ|m[³3]|톤|ton|재생|산재|재해|사고|현금배당성향|여성|출석률|안건|의안|공고|위반|과징금"
# How the directors are counted, in the order in which the places are looked at.
BOARD_TABLE = r"이사의?\s*수\s*사외이사\s*수[^\d]{0,60}?(\d+)\s+(\d+)\b"
OUTSIDE = [r"(\d+)\s*[인명]\s*의\s*사외이사", r"사외이사\s*(\d+)\s*[인명]"]
TOTALS = [r"이사회(?:는|가)?\s*총\s*(\d+)\s*[명인]", r"(?:이사의?\s*총?\s*수|등기이사\s*수|총\s*이사\s*수)\s*[:은는]?\s*(\d+)\s*[명인]"]
INSIDE = r"(\d+)\s*[인명]\s*의\s*사내이사|사내이사\s*(\d+)\s*[인명]"
# Social figures in sentences, a label, a value and, for money, a unit; the unit of the others.
SOCIAL = [
    (r"(신규\s*채용|정규직|비정규직|퇴직|이직|장애인\s*고용|여성\s*인력|여성\s*임직원)\s*(?:인원|수)?(?:\s*[은는이])?[^0-9]{0,5}([\d,]+)\s*명", "명"),
    (r"(정규직\s*비율|비정규직\s*비율|이직률|퇴사율|재해율|사망만인율|LTIFR|여성\s*비율|여성\s*구성원\s*비율|여성\s*급여\s*비율|장애인\s*고용률|노조\s*가입률|봉사\s*참여율)\s*(?:은|는|이|:)?\s*(\d+\.?\d*)\s*%", "%"),
    (r"(교육훈련비|1인당\s*교육비|복리후생비|1인당\s*복리후생)\s*(?:은|는|이|:)?\s*([\d,]+)\s*(만\s*원|천\s*원|억\s*원|원)", None),
    (r"(개인정보\s*(?:침해|유출)|사회\s*법규\s*위반|노동\s*법규\s*위반|과징금\s*부과)\s*(?:건수|횟수)?(?:\s*[은는이])?[^0-9]{0,5}(\d+)\s*건", "건"),
]
MONEY = {"만원": 1e4, "천원": 1e3, "억원": 1e8, "원": 1.0}
LABELS = {
    "신규채용": "S-2-1", "정규직": "S-2-2", "정규직비율": "S-2-2", "비정규직비율": "S-2-2", "이직률": "S-2-3", "자발적이직률": "S-2-3", "퇴사율": "S-2-3", "교육훈련비": "S-2-4", "1인당교육비": "S-2-4",
    "복리후생비": "S-2-5", "1인당복리후생": "S-2-5", "노조가입률": "S-2-6", "여성비율": "S-3-1", "여성구성원비율": "S-3-1", "여성인력": "S-3-1", "여성임직원": "S-3-1", "여성급여비율": "S-3-2",
    "장애인고용률": "S-3-3", "장애인고용": "S-3-3", "재해율": "S-4-2", "사망만인율": "S-4-2", "LTIFR": "S-4-2", "봉사참여율": "S-7-2", "개인정보침해": "S-8-2", "개인정보유출": "S-8-2", "사회법규위반": "S-9-1", "노동법규위반": "S-9-1",
}
# Rows of a table of employees whose markup is gone, where its section starts and ends.
SECTION, SECTION_END, SECTION_LENGTH = ["직원 등의 현황", "직원 등 현황", "직원현황"], "미등기임원 보수", 30_000
ALL_STAFF = r"합\s*계\s+([\d,]+)\s+[\d,-]+\s+([\d,]+)\s+[\d,-]+\s+([\d,]+)\s+([\d.]+)"
BY_SEX = r"성별합계\s+(남|여)\s+([\d,]+)\s+[\d,-]+\s+([\d,]+)\s+[\d,-]+\s+([\d,]+)"
BY_UNIT = r"\S+(?:부문|직)\s+(남|여)\s+([\d,]+)\s+[\d,-]+\s+([\d,]+)\s+[\d,-]+\s+([\d,]+)"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _first(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The number of the first pattern that is found at all."""
    return F.coalesce(*[F.when(text.rlike(p), _number(F.regexp_extract(text, p, group))) for p in patterns])


def board_ratio(text: Column) -> Column:
    """Outside directors in per cent of all: from the standard table, else from counts in sentences; null where they don't add up."""
    def share(outside: Column, whole: Column) -> Column:
        return F.when((whole >= outside) & (outside > 0), F.round(outside / whole * 100, 1))

    outside = _first(text, OUTSIDE)
    inside = F.coalesce(_number(F.regexp_extract(text, INSIDE, 1)), _number(F.regexp_extract(text, INSIDE, 2)))
    whole = F.coalesce(_first(text, TOTALS), outside + inside)
    return F.coalesce(share(_first(text, [BOARD_TABLE], 2), _first(text, [BOARD_TABLE], 1)), share(outside, whole))


def filing_figures(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, code, value, unit, rule): of each text the value of each code by its first rule that finds a number; rule counts from 0.

    Letters match in either case. A match that is no number ("1.2.3") leaves its code to later rules. The share of outside
    directors (G-1-2, rule null) stands only where it can be worked out. Null and empty texts have no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = []
    for number, (code, unit, pattern, factor) in enumerate(RULES):
        value = _number(F.regexp_extract(text, f"(?i){pattern}", 1))
        made.append(F.when(value.isNotNull(), F.struct(F.lit(code).alias("code"), (value * factor).alias("value"), F.lit(unit).alias("unit"), F.lit(number).alias("rule"))))
    by_code = [F.coalesce(*[m for m, r in zip(made, RULES) if r[0] == code]) for code in dict.fromkeys(r[0] for r in RULES)]
    ratio = board_ratio(text)
    board = F.when(ratio.isNotNull(), F.struct(F.lit("G-1-2").alias("code"), ratio.alias("value"), F.lit("%").alias("unit"), F.lit(None).cast("int").alias("rule")))
    kind = "array<struct<code:string,value:double,unit:string,rule:int>>"
    found = F.concat(F.when(text.rlike(f"(?i){GATE}"), F.array_compact(F.array(*by_code))).otherwise(F.array().cast(kind)), F.when(F.contains(text, F.lit("이사")), F.array_compact(F.array(board))).otherwise(F.array().cast(kind)))
    return texts.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")


def social_figures(texts: DataFrame, known: DataFrame | None = None, keys: list[str] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, code, value, unit): social figures in sentences, the first of each code in a text: head counts, ratios, money in won, counts.

    A label has the code of the first known label that holds it or that it holds, blanks left out; labels without one are passed over. known,
    where given, has the keys (which texts have too) and code: figures that are there already, which are not read again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    labels = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).alias("code")) for w, c in LABELS.items()])
    factors = F.create_map(*[F.lit(x) for pair in MONEY.items() for x in pair])
    plain = lambda x: F.regexp_replace(x, " ", "")

    def code(label: Column) -> Column:
        return F.get(F.filter(labels, lambda k: F.contains(label, k["w"]) | F.contains(k["w"], label)), F.lit(0))["code"]

    parts = []
    for pattern, unit in SOCIAL:
        group = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))  # noqa: B023, E731
        if unit:
            parts.append(F.zip_with(group(1), group(2), lambda a, b: F.struct(code(plain(a)).alias("code"), _number(b).alias("value"), F.lit(unit).alias("unit"))))  # noqa: B023
        else:
            rows = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"))
            parts.append(F.transform(rows, lambda x: F.struct(code(plain(x["a"])).alias("code"), (_number(x["b"]) * F.try_element_at(factors, plain(x["c"]))).alias("value"), F.lit("원").alias("unit"))))
    rows = texts.select(id_col, *(keys or []), F.posexplode(F.concat(*parts)).alias("_at", "x")).where("x.code IS NOT NULL AND x.value IS NOT NULL")
    first = rows.groupBy(id_col, *(keys or []), F.col("x.code").alias("code")).agg(F.min_by("x", "_at").alias("x")).select(id_col, *(keys or []), "code", "x.value", "x.unit")
    return first.join(known.select(*keys, "code").distinct(), [*keys, "code"], "left_anti") if known is not None else first


def staff_section(text: Column) -> Column:
    """From the first heading of the section on employees that is no line of a table of contents to the next section, or 30,000 characters."""
    heads = [F.regexp_extract(text, rf"(?s){marker}(?!.{{0,77}}?---|.{{0,75}}?\s\d{{3}}\s).*", 0) for marker in SECTION]
    found = F.coalesce(*[F.when(h != "", h) for h in heads])
    end = F.instr(found, F.lit(SECTION_END))
    return F.substr(found, F.lit(1), F.when(end > 0, end - 1).otherwise(SECTION_LENGTH))


def staff_ratios(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, code, value): regular staff (S-2-2) and women (S-3-1) in per cent, from rows of the employees' table in a text whose markup is gone.

    The total row counts above 100 staff; sexes come from their total rows (the last of each), else from the sums over units. Texts
    without such a section have no rows.
    """
    rows = texts.select(id_col, staff_section(F.coalesce(F.col(text_col), F.lit(""))).alias("s")).where("s IS NOT NULL")
    regular, whole = (F.when(F.col("s").rlike(ALL_STAFF), _number(F.regexp_extract("s", ALL_STAFF, g))) for g in (1, 3))

    def by(pattern: str, sex: str, every: bool) -> Column:
        pairs = F.zip_with(F.regexp_extract_all("s", F.lit(pattern), F.lit(1)), F.regexp_extract_all("s", F.lit(pattern), F.lit(4)), lambda a, b: F.struct(a.alias("sex"), _number(b).alias("n")))
        mine = F.transform(F.filter(pairs, lambda x: x["sex"] == sex), lambda x: x["n"])
        return F.aggregate(mine, F.lit(0.0), (lambda a, n: a + n) if every else (lambda a, n: n))

    total = by(BY_SEX, "남", False) + by(BY_SEX, "여", False)
    men, women = (F.when(total == 0, by(BY_UNIT, sex, True)).otherwise(by(BY_SEX, sex, False)) for sex in ("남", "여"))
    rows = rows.select(id_col, regular.alias("regular"), whole.alias("whole"), men.alias("men"), women.alias("women"))
    both = F.col("men") + F.col("women")
    found = F.array_compact(F.array(
        F.when((F.col("whole") > 100) & (F.col("regular") <= F.col("whole")), F.struct(F.lit("S-2-2").alias("code"), F.round(F.col("regular") / F.col("whole") * 100, 1).alias("value"))),
        F.when(both > 100, F.struct(F.lit("S-3-1").alias("code"), F.round(F.col("women") / both * 100, 1).alias("value"))),
    ))
    return rows.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")


def employee_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, female_ratio, regular_ratio) from rows (keys, sex, staff, regular) of a company's report, null where nothing is counted."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    of = lambda sex: F.sum(F.when(F.trim("sex") == sex, n("staff")).otherwise(0.0))
    sums = rows.groupBy(*keys).agg(of("여").alias("women"), of("남").alias("men"), F.sum(n("regular")).alias("regular"), F.sum(n("staff")).alias("staff"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b * 100, 1))
    return sums.select(*keys, ratio(F.col("women"), F.col("women") + F.col("men")).alias("female_ratio"), ratio(F.col("regular"), F.col("staff")).alias("regular_ratio"))
