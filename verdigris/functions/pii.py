"""Personal data in text, masked. Only strings are touched, however deep they lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is masked, in this order, and by what.
MASKS = [
    (r"(?<!\d)\d{4}-\d{4}-\d{4}-\d{4}(?!\d)", "[CARD]"),
    (r"(?<!\d)\d{6}-\d{7}(?!\d)", "[RRN]"),
    (r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)", "[BRN]"),
    (r"(?<!\d)01[016-9]-\d{3,4}-\d{4}(?!\d)", "[PHONE]"),
    (r"(?<!\d)0\d{1,2}-\d{3,4}-\d{4}(?!\d)", "[PHONE]"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
]
ACCOUNT, ACCOUNT_DIGITS = r"(?<!\d)\d{2,6}-\d{2,6}-\d{2,6}(?:-\d{2,6})?(?!\d)", 10


def masked(text: Column) -> Column:
    """The text without cards, resident and business numbers, phones, e-mails, and accounts: three or four groups of
    digits with ten digits or more together. Dates and other short groups stay; null stays null.
    """
    for pattern, label in MASKS:
        text = F.regexp_replace(text, pattern, label)
    # What the patterns left is bound, as it is looked at four times and would be masked anew each time.
    return F.element_at(F.transform(F.array(text), _without_accounts), 1)


def _without_accounts(text: Column) -> Column:
    # A group is an account by its digits, which no pattern counts: hits and the pieces between them are joined again.
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({ACCOUNT})"), F.lit(1)), lambda h: F.when(F.length(F.replace(h, F.lit("-"), F.lit(""))) >= ACCOUNT_DIGITS, "[ACCT]").otherwise(h))
    parts = F.arrays_zip(F.split(text, ACCOUNT, -1).alias("piece"), hits.alias("hit"))
    return F.when(text.rlike(ACCOUNT), F.array_join(F.flatten(F.transform(parts, lambda p: F.array(p["piece"], F.coalesce(p["hit"], F.lit(""))))), "")).otherwise(text)


def masked_deep(value: Column, kind: T.DataType) -> Column:
    """The value with every string in it masked: in structs, arrays and map values. Keys and other types stay."""
    if isinstance(kind, T.StringType):
        return masked(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: masked_deep(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: masked_deep(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[masked_deep(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value
