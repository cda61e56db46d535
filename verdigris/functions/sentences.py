"""Sentences, citations and what makes a line a claim, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATION = r"\[([0-9A-Za-z가-힣._:-]+)\]"


def sentences(text: Column, end: str = ".!?。\\n") -> Column:
    """Pieces between white space that follows an end of sentence, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.trim(text), rf"(?<=[{end}])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def structural(line: Column) -> Column:
    """Headings, table rows and quotations."""
    return line.startswith("#") | line.startswith("|") | line.startswith(">")


def is_claim(line: Column) -> Column:
    """At least six characters with a letter, and no structural line."""
    return (F.char_length(line) >= 6) & ~structural(line) & line.rlike("[A-Za-z가-힣]")


def citations(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(CITATION), F.lit(1))


def without_citations(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, CITATION, ""), r"\s{2,}", " "))


def cited_lines(text: Column) -> Column:
    """array<struct<clean, cited>> of the lines that are no structure."""
    made = F.transform(F.filter(lines(text), lambda s: ~structural(s)), lambda s: F.struct(without_citations(s).alias("clean"), citations(s).alias("cited")))
    return F.filter(made, lambda x: x["clean"] != "")
