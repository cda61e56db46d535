"""Numbers and units in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How units are written, and what they are called. Lower case.
UNIT_NAMES = {
    "t": "t", "ton": "t", "tons": "t", "톤": "t", "tco2eq": "tCO2eq", "tco2": "tCO2eq", "톤co2eq": "tCO2eq", "톤co2": "tCO2eq",
    "kwh": "kWh", "킬로와트시": "kWh", "mwh": "MWh", "메가와트시": "MWh", "gwh": "GWh", "기가와트시": "GWh",
    "%": "%", "퍼센트": "%", "원": "원", "백만원": "백만원", "억원": "억원", "명": "명", "인": "명",
}
# Units that convert, by family, and how many of the first unit each is.
UNIT_FAMILIES = {"kWh": ("energy", 1.0), "MWh": ("energy", 1e3), "GWh": ("energy", 1e6), "원": ("money", 1.0), "백만원": ("money", 1e6), "억원": ("money", 1e8)}
# Factors of Korean number words.
KOREAN_FACTORS = {"만": 1e4, "억": 1e8, "조": 1e12}
NUMBER = r"\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?"
NUMBER_UNIT = rf"(?i)({NUMBER})\s*(톤CO2eq|톤CO2|tCO2eq|tCO2|톤|ton|tons|t|킬로와트시|kWh|메가와트시|MWh|기가와트시|GWh|퍼센트|%|백만원|억원|원|명|인)"
#: A number as it may stand alone: grouped by commas, in scientific notation, or plain.
BARE_NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$"


def lookup(key: Column, values: dict[str, object]) -> Column:
    """The value of a key in a small fixed table, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def bare_number(text: Column) -> Column:
    """A comma-grouped, scientific or plain number as a double; null for anything else."""
    return F.when(text.rlike(BARE_NUMBER), F.regexp_replace(text, ",", "").try_cast("double"))


def parse_number(text: Column) -> Column:
    """bare_number, with a Korean factor after it where there is one ("1.5만")."""
    trimmed = F.trim(text)
    word = F.regexp_extract(trimmed, r"^[+-]?\d[\d,]*(?:\.\d+)?\s*(만|억|조)$", 1)
    base = F.regexp_extract(trimmed, r"^([+-]?\d[\d,]*(?:\.\d+)?)\s*(?:만|억|조)$", 1)
    return F.when(word != "", bare_number(base) * lookup(word, KOREAN_FACTORS)).otherwise(bare_number(trimmed))


def unit_name(raw: Column) -> Column:
    return lookup(F.lower(F.trim(raw)), UNIT_NAMES)


def to_base(value: Column, unit: Column) -> Column:
    """The value in its family's first unit; itself where the unit has no family."""
    return value * F.coalesce(lookup(unit, {k: f for k, (_, f) in UNIT_FAMILIES.items()}), F.lit(1.0))


def unit_kind(unit: Column) -> Column:
    """Units that compare with one another have one kind: their family's name, or their own."""
    return F.coalesce(lookup(unit, {k: kind for k, (kind, _) in UNIT_FAMILIES.items()}), unit)


def close(a: Column, b: Column, share: float = 0.01) -> Column:
    """Whether a and b differ by at most that share of the larger."""
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))


def number_unit_pairs(text: Column) -> Column:
    """array<struct<value, unit, kind, base>> of the numbers with a known unit."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBER_UNIT), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(NUMBER_UNIT), F.lit(2)).alias("u"))
    named = F.transform(found, lambda x: F.struct(parse_number(x["n"]).alias("value"), unit_name(x["u"]).alias("unit")))
    return F.transform(F.filter(named, lambda x: x["value"].isNotNull() & x["unit"].isNotNull()), lambda x: F.struct(x["value"], x["unit"], unit_kind(x["unit"]).alias("kind"), to_base(x["value"], x["unit"]).alias("base")))


def is_year(token: Column) -> Column:
    """Four digits from 1900 to 2100."""
    return token.rlike(r"^\d{4}$") & token.try_cast("int").between(1900, 2100)


def number_tokens(text: Column) -> Column:
    """Numbers as written, without commas; years of reports left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "")), lambda x: ~is_year(x))


def number_values(text: Column) -> Column:
    """The values of all numbers, years too."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: bare_number(F.regexp_replace(x, ",", "")))


def plain(value: Column) -> Column:
    """A double as a number is written: whole ones without a point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
