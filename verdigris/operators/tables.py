"""Tables read from documents: gates on their structure, sums and confidence, and a deterministic restoration.

cells: one row a cell with table_id, r, c (from 0), content, row_span, col_span, confidence (null where unknown) and
ord, the order they were read in. A table known to have no cell has one row without r. Cells are few bytes and much work: `tasks` says
into how many tasks they are dealt by table_id; without it Spark decides by bytes. `gathered` says that the rows of a table
stand together in one task already, in their order, and that one can hold its slots.

Patterns and casts are tried on each cell; tables then go by many at once through one pass over arrays (`grids`), which has a table's slots
in memory. Where a table reaches beyond NARROW, all go by windows, groups and joins by (table_id, ...) instead, on one exchange, as these spill.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grids

# Labels of totals, units, numbers and years; limits of the signals.
TOTAL = r"(?i)(합계|소계|총계|계\b|total|subtotal)"
UNIT = r"(?i)(%|kwh|mwh|gwh|mj|gj|tco2e?q?|ton|톤|kg|m3|㎥|l\b|ℓ|원|krw|usd)"
NUMERIC = r"^\s*[-(]?\d[\d,\s]*(?:\.\d+)?\)?\s*%?\s*$"
YEAR = r"\b(?:19|20)\d{2}\b"
#: No total and no unit begins without one of these: most texts need no look at each alternative.
TOTAL_BEGINS, UNIT_BEGINS = "[합소총계tTsS]", "[%kKmMgGtTlLuU톤㎥ℓ원]"
CONFUSED, MEANT = "OoIl|", "00111"
LOW_CONFIDENCE = 0.6
SIGNALS = ("A1_rectangularity", "A2_blank_ratio", "A3_header_presence", "A4_column_type_consistency", "B1_total_consistency", "B2_unit_presence", "B3_magnitude_outlier", "B4_year_order", "C1_confidence_average", "C2_low_confidence_ratio")
HARD = {"A1_rectangularity", "B1_total_consistency", "C2_low_confidence_ratio"}
#: Rows and columns of a table that a task can hold: a million slots of about 100 bytes.
NARROW = (4096, 256)


def has_unit(text: Column) -> Column:
    return F.when(text.rlike(UNIT_BEGINS), text.rlike(UNIT)).otherwise(False)


def has_total(text: Column) -> Column:
    return F.when(text.rlike(TOTAL_BEGINS), text.rlike(TOTAL)).otherwise(False)


def numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def to_float(text: Column) -> Column:
    """A cell's number; parentheses are dropped, not negated. What can't begin a number isn't cast, as a cast that fails costs most."""
    number = F.regexp_replace(F.regexp_replace(text, r"[%,\s]", ""), r"^[()]+|[()]+$", "").try_cast("double")
    return F.when(text.rlike(r"^[\x00-\x20\x7F%,()]*[-+]?[\x00-\x20\x7F%,]*[0-9.iInN]"), number)


def _dealt(cells: DataFrame, tasks: int | None) -> DataFrame:
    rows = cells.select("table_id", "r", "c", "content", "row_span", "col_span", "confidence", "ord")
    return rows.repartition(tasks, "table_id") if tasks else rows.repartition("table_id")


def _held(cells: DataFrame, gathered: bool) -> bool:
    """Whether no table reaches beyond NARROW."""
    reach = lambda at, span: F.col(at) + F.greatest(span, F.lit(1))
    return gathered or not cells.where((reach("r", "row_span") > NARROW[0]) | (reach("c", "col_span") > NARROW[1])).head(1)


def _together(cells: DataFrame, tasks: int | None, gathered: bool) -> DataFrame:
    """cells with the rows of a table one after another in one task, as they were read."""
    return cells if gathered else _dealt(cells, tasks).sortWithinPartitions("table_id", F.asc_nulls_last("ord"))


def _by_blocks(run: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grids.blocks(batches):
            yield from run(rows).to_batches()

    return each


def _placed(cells: DataFrame, *kept: str) -> DataFrame:
    """Where a cell stands, in whole numbers, and its text."""
    spans = [F.greatest(k, F.lit(1)).cast("int").alias(k) for k in ("row_span", "col_span")]
    return cells.select("table_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *spans, F.col("confidence").cast("double").alias("confidence"), F.trim(F.coalesce("content", F.lit(""))).alias("text"), *kept)


def _bits(**flags: Column) -> Column:
    """`flags` of a cell."""
    return functools.reduce(lambda a, b: a + b, [F.when(flags[name], 1 << bit).otherwise(0) for bit, name in enumerate(grids.FLAGS) if name in flags])


def _told(cells: DataFrame, mend: bool, *kept: str) -> DataFrame:
    """What `grids` needs of cells that stand together by table: for the gate, and for restoration too."""
    text, top, size = F.col("text"), F.col("r") < 3, F.abs("value")  # a header has two rows at most, and a unit may stand in the one below
    rows = _placed(cells, *kept).withColumns({"num": numeric(text), "unit": (F.lit(True) if mend else top) & has_unit(text), "dated": (F.lit(True) if mend else top) & text.rlike(YEAR), "value": to_float(text)})
    flags = _bits(full=text != "", num=F.col("num"), marked=F.col("unit") | F.col("dated"), unit=F.col("unit"), total=~F.col("num") & has_total(text))
    digits = F.when(size >= 1, F.length(F.floor(size).cast("string"))).when(size.isNotNull(), 1).otherwise(0)
    years = F.when(top & F.col("dated"), F.array_join(F.regexp_extract_all("text", F.lit(f"({YEAR})"), F.lit(1)), ""))
    meant = F.translate(text, CONFUSED, MEANT)
    fixed = F.when((meant != text) & text.rlike(r"\d") & numeric(meant), meant)
    return rows.select("table_id", "r", "c", "row_span", "col_span", "confidence", "value", years.alias("years"), (flags + digits * (1 << grids.DIGITS)).alias("flags"), *(["text", fixed.alias("fixed")] if mend else []), *kept)


def _kinds(rows: DataFrame, columns: str) -> str:
    return f"table_id {rows.schema['table_id'].dataType.simpleString()}, {columns}"


MEASURES = ", ".join(f"{name} {'boolean' if str(kind) == 'bool' else 'double'}" for name, kind in grids.SIGNALS)
RESTORED = "r int, c int, content string, confidence double"


def _failed(met: DataFrame, *kept: str) -> DataFrame:
    """(table_id, failed) of measured tables."""
    out = _decided(met.withColumns({"mean": F.round("mean", 9), "low": F.round("low", 9)}), "empty", *kept)
    return out.select("table_id", F.when(F.col("empty"), F.array(F.lit("TABLE_EMPTY"))).otherwise(F.col("failed")).alias("failed"), *kept)


def _verdict(failed: Column) -> tuple[Column, Column, Column]:
    """Decision, hard and soft signals of a table by what failed."""
    none = F.array_contains(failed, "TABLE_EMPTY")
    hard = F.size(F.array_intersect(failed, F.array(*map(F.lit, sorted(HARD)), F.lit("TABLE_EMPTY"))))
    soft = F.size(failed) - hard
    return F.when(none, "HUMAN").when(hard > 0, "ESCALATE").when(soft <= 1, "ACCEPT").otherwise("ESCALATE"), hard, soft


def _judged(cells: DataFrame) -> DataFrame:
    """table_gate of cells that stand together by table."""
    rows = _told(cells, False)
    out = _failed(rows.mapInArrow(_by_blocks(lambda t: grids.signals(t, LOW_CONFIDENCE)), _kinds(rows, MEASURES)))
    decision, hard, soft = _verdict(F.col("failed"))
    return out.select("table_id", decision.alias("decision"), hard.alias("hard"), soft.alias("soft"), ((hard == 0) & soft.between(2, 3)).alias("semantic"), "failed")


def _mended(cells: DataFrame) -> DataFrame:
    """restored of cells that stand together by table, as its rows then do."""
    rows, one = _told(cells, True), F.lit(1)
    done = rows.mapInArrow(_by_blocks(grids.restore), _kinds(rows, RESTORED))
    return done.select("table_id", "r", "c", "content", one.alias("row_span"), one.alias("col_span"), "confidence", F.lit(0).alias("ord"))


def _cascaded(cells: DataFrame) -> DataFrame:
    """table_cascade of cells that stand together by table: read once. A restored table begins with a row that has no place, whose content names
    the signals that failed before.
    """
    rows, one = _told(cells, True), F.lit(1)
    done = rows.mapInArrow(_by_blocks(lambda t: grids.both(t, LOW_CONFIDENCE)), _kinds(rows, f"{RESTORED}, {MEASURES}"))
    done = _failed(done, "r", "c", "content", "confidence")
    done = done.select("table_id", "r", "c", F.when(F.col("r").isNull(), F.lit("")).otherwise(F.col("content")).alias("content"), one.alias("row_span"), one.alias("col_span"), "confidence", F.lit(0).alias("ord"), F.when(F.col("r").isNull(), F.array_join("failed", ",")).alias("before"))
    rows = _told(done, False, "before")
    out = _failed(rows.mapInArrow(_by_blocks(lambda t: grids.signals(t, LOW_CONFIDENCE, "before")), _kinds(rows, f"{MEASURES}, before string")), "before")
    out = out.select("table_id", F.when(F.col("before") == "", F.array().cast("array<string>")).otherwise(F.split("before", ",")).alias("failed0"), F.col("failed").alias("failed1"))
    return out.select("table_id", _verdict(F.col("failed0"))[0].alias("tier0"), "failed0", _verdict(F.col("failed1"))[0].alias("tier1"), "failed1")


def slots(cells: DataFrame) -> DataFrame:
    """(table_id, r, c, text, confidence, occupied, n_sure, sum_sure, n_low): every slot of a table's grid, spans spread out; the first cell
    read wins a slot. The last three are of the cells that begin there: how many have a confidence, its sum, and how many a low one.
    """
    at = cells.where("r IS NOT NULL").select("table_id", F.struct("r", "c").alias("_at"), F.explode(F.sequence("r", F.col("r") + F.greatest("row_span", F.lit(1)) - 1)).alias("r"), "c", "col_span", "content", "confidence", "ord")
    spread = at.select("table_id", "_at", "r", F.explode(F.sequence("c", F.col("c") + F.greatest("col_span", F.lit(1)) - 1)).alias("c"), "content", "confidence", "ord")
    sure = F.when(F.struct("r", "c") == F.col("_at"), F.col("confidence"))
    held = spread.groupBy("table_id", "r", "c").agg(F.min_by(F.struct("content", "confidence"), "ord").alias("x"), F.count(sure).alias("n_sure"), F.sum(sure).alias("sum_sure"), F.count_if(sure < LOW_CONFIDENCE).alias("n_low"))
    # A row of a table is made whole from the slots it holds: the grid needs no join.
    by_row = held.groupBy("table_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("x", "n_sure", "sum_sure", "n_low")))).alias("row"), F.max("c").alias("_c"))
    whole = Window.partitionBy("table_id")
    by_row = by_row.withColumns({"_c": F.max("_c").over(whole), "_next": F.lead("r", 1).over(whole.orderBy("r")), "_first": F.min("r").over(whole)})
    # Rows that no cell reaches lie before the first or between two: each row brings the empty ones that follow it.
    low = F.when(F.col("r") == F.col("_first"), 0).otherwise(F.col("r"))
    rows = by_row.select("table_id", F.explode(F.sequence(low, F.coalesce(F.col("_next") - 1, F.col("r")))).alias("_row"), F.col("r").alias("_own"), "row", "_c")
    grid = rows.select("table_id", F.col("_row").alias("r"), F.explode(F.sequence(F.lit(0), "_c")).alias("c"), "_own", "row")
    grid = grid.select("table_id", "r", "c", F.when(F.col("r") == F.col("_own"), F.try_element_at("row", F.col("c"))).alias("s"))
    zero = F.lit(0).cast("long")
    return grid.select(
        "table_id", "r", "c", F.trim(F.coalesce("s.x.content", F.lit(""))).alias("text"), F.col("s.x.confidence").alias("confidence"), F.col("s").isNotNull().alias("occupied"),
        F.coalesce("s.n_sure", zero).alias("n_sure"), F.coalesce("s.sum_sure", F.lit(0.0)).alias("sum_sure"), F.coalesce("s.n_low", zero).alias("n_low"),
    )


def described(grid: DataFrame) -> DataFrame:
    """slots with depth (rows of the header), whether their column is numeric, their row a total, and their value."""
    whole, column, row = (Window.partitionBy("table_id", *k) for k in ((), ("c",), ("r",)))
    # In the order of columns the windows of tables and of columns need no sort of their own.
    grid = grid.withColumns({"full": F.col("text") != "", "num": (F.col("text") != "") & numeric(F.col("text"))}).sortWithinPartitions("table_id", "c", "r")
    full, num = F.col("full"), F.col("num")
    like = (F.col("r") == 1) & (F.col("text").rlike(YEAR) | F.col("text").rlike(UNIT))

    def share(test: Column, r: int) -> Column:
        return F.sum(F.when(full & test & (F.col("r") == r), 1).otherwise(0)).over(whole) / F.sum(F.when(full & (F.col("r") == r), 1)).over(whole)

    first = F.coalesce(share(num, 0) < 0.5, F.lit(False))
    second = F.coalesce((share(num, 1) < 0.5) | (first & (share(like, 1) >= 0.5)), F.lit(False))
    rows = grid.withColumn("depth", F.greatest(F.lit(1), first.cast("int") + second.cast("int")))
    body = F.col("r") >= F.col("depth")
    rows = rows.withColumns({"body": body, "column_share": F.sum(F.when(body & num, 1).otherwise(0)).over(column) / F.sum(F.when(body & full, 1)).over(column)})
    label = F.min(F.when(F.col("full") & ~F.col("num"), F.struct("c", "text"))).over(row)["text"]
    return rows.withColumns({"number_column": F.coalesce(F.col("column_share") >= 0.8, F.lit(False)), "total": F.col("body") & F.coalesce(label.rlike(TOTAL), F.lit(False)), "value": F.when(F.col("body"), to_float(F.col("text")))})


def table_gate(cells: DataFrame, tasks: int | None = None, gathered: bool = False) -> DataFrame:
    """(table_id, decision, hard, soft, semantic, failed): failed lists the signals that did not pass, in their order.

    A hard signal escalates; up to one soft one is accepted, two or three ask for a semantic check, more escalate.
    A table without a single cell (one row without r) goes to a person: HUMAN, with the one hard signal TABLE_EMPTY.
    """
    return _judged(_together(cells, tasks, gathered)) if _held(cells, gathered) else _gated(_dealt(cells, tasks))


def _gated(cells: DataFrame) -> DataFrame:
    """table_gate of cells that are dealt out by table_id."""
    rows = described(slots(cells))
    below = Window.partitionBy("table_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    part = F.when(F.col("body") & ~F.col("total"), F.col("value"))
    rows = rows.withColumn("per_row", F.sum(F.col("occupied").cast("int")).over(Window.partitionBy("table_id", "r"))).withColumn("columns", F.max("c").over(Window.partitionBy("table_id")) + 1)
    rows = rows.withColumn("above", F.sum(part).over(below))
    off = F.col("total") & F.col("number_column") & (F.abs(F.col("above") - F.col("value")) > F.greatest(F.lit(1.0), F.abs("above") * 0.005))
    digits = F.when(F.col("body") & F.col("value").isNotNull(), F.when(F.abs("value") >= 1, F.length(F.floor(F.abs("value")).cast("string"))).otherwise(1))
    head, lead = ~F.col("body"), F.col("c") == 0
    # All signals come from one pass: sums by column, and of those by table.
    by_column = rows.groupBy("table_id", "c").agg(
        F.count_if(lead & (F.col("per_row") != F.col("columns"))).alias("ragged"), F.count_if(lead).alias("lines"), F.count_if(~F.col("full")).alias("blank"), F.count(F.lit(1)).alias("slots"),
        F.count_if(head & F.col("num")).alias("head_numbers"), F.count_if(head & F.col("full")).alias("heads"), F.coalesce(F.bool_or(off), F.lit(False)).alias("off"),
        F.coalesce(F.bool_or((F.col("r") <= F.col("depth")) & F.col("text").rlike(UNIT)), F.lit(False)).alias("unit"), F.bool_or("number_column").alias("number"), F.first("column_share").alias("share"),
        F.count(digits).alias("n"), F.median(digits).alias("mid"), F.max(digits).alias("most"), F.min(digits).alias("least"),
        F.collect_list(F.when(head, F.struct("r", "c", F.regexp_extract_all("text", F.lit(f"({YEAR})"), F.lit(1)).alias("y")))).alias("years"), F.sum("n_sure").alias("n_sure"), F.sum("sum_sure").alias("sum_sure"), F.sum("n_low").alias("n_low"),
    )
    wild = F.col("number") & (F.col("n") >= 3) & (F.greatest(F.col("most") - F.col("mid"), F.col("mid") - F.col("least")) >= 3)
    weight = F.when(F.col("number"), 2.0).otherwise(1.0)
    met = by_column.groupBy("table_id").agg(
        (F.sum("ragged") / F.sum("lines")).alias("ragged"), (F.sum("blank") / F.sum("slots")).alias("blank"), F.try_divide(F.sum("head_numbers"), F.sum("heads")).alias("head_numbers"), F.bool_or("off").alias("off"), F.bool_or("unit").alias("unit"),
        F.bool_or("number").alias("numbers"), F.bool_or(wild).alias("wild"), F.max(F.when(F.col("number"), 1 - F.col("share"))).alias("mixed"), F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("years"))), lambda x: x["y"])).alias("years"),
        F.round(F.try_divide(F.sum("sum_sure"), F.sum("n_sure")), 9).alias("mean"), F.round(F.try_divide(F.sum(weight * F.col("n_low")), F.sum(weight * F.col("n_sure"))), 9).alias("low"),
    )
    met = met.withColumn("ordered", (F.size("years") < 3) | (F.array_sort("years") == F.col("years")) | (F.reverse(F.array_sort("years")) == F.col("years")))
    out = _decided(met)
    empty = cells.groupBy("table_id").agg(F.count("r").alias("n")).where("n = 0")
    return out.unionByName(empty.select("table_id", F.lit("HUMAN").alias("decision"), F.lit(1).alias("hard"), F.lit(0).alias("soft"), F.lit(False).alias("semantic"), F.array(F.lit("TABLE_EMPTY")).alias("failed")))


def _decided(met: DataFrame, *kept: str) -> DataFrame:
    """What the measures of a table come to."""
    passed = {
        "A1_rectangularity": F.col("ragged") <= 0.05, "A2_blank_ratio": F.col("blank") <= 0.20, "A3_header_presence": F.coalesce(F.col("head_numbers") < 0.5, F.lit(False)),
        "A4_column_type_consistency": F.coalesce(F.col("mixed"), F.lit(0.0)) <= 0.10, "B1_total_consistency": ~F.col("off"), "B2_unit_presence": F.col("unit") | ~F.col("numbers"),
        "B3_magnitude_outlier": ~F.coalesce("wild", F.lit(False)), "B4_year_order": F.col("ordered"), "C1_confidence_average": F.coalesce(F.col("mean") >= 0.85, F.lit(True)), "C2_low_confidence_ratio": F.coalesce(F.col("low") <= 0.10, F.lit(True)),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in passed.items()]))
    hard = F.size(F.array_intersect(failed, F.array(*map(F.lit, sorted(HARD)))))
    out = met.select("table_id", failed.alias("failed"), hard.alias("hard"), (F.size(failed) - hard).alias("soft"), *kept)
    decision = F.when(F.col("hard") > 0, "ESCALATE").when(F.col("soft") <= 1, "ACCEPT").otherwise("ESCALATE")
    return out.select("table_id", decision.alias("decision"), "hard", "soft", ((F.col("hard") == 0) & F.col("soft").between(2, 3)).alias("semantic"), "failed", *kept)


def _without_empty(grid: DataFrame) -> DataFrame:
    """Rows and columns that hold a text, numbered anew. A row that holds a text does so in a column that stays, so rows go and are numbered
    first, and columns then, each in one order.
    """
    has = lambda *k: F.bool_or(F.col("text") != "").over(Window.partitionBy("table_id", *k))
    at = lambda k: F.dense_rank().over(Window.partitionBy("table_id").orderBy(k)) - 1
    for k in ("r", "c"):
        grid = grid.withColumn("_has", has(k)).where("_has").drop("_has").withColumn(k, at(k))
    return grid


def restored(cells: DataFrame, tasks: int | None = None, gathered: bool = False) -> DataFrame:
    """cells of the tables as rules repair them: empty rows and columns dropped, merged headers filled from above, else
    from the left, misread digits in numeric columns put right, a header of two rows flattened with "_".
    """
    return _mended(_together(cells, tasks, gathered)) if _held(cells, gathered) else _repaired(_dealt(cells, tasks))


def _repaired(cells: DataFrame) -> DataFrame:
    """restored of cells that are dealt out by table_id, which its rows then are too."""
    rows = described(_without_empty(slots(cells).select("table_id", "r", "c", "text", "confidence")))
    left = Window.partitionBy("table_id", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("table_id", "c").orderBy("r")
    blank = lambda x: F.when(x != "", x)
    rows = rows.withColumn("first", F.when(F.col("r") == 0, F.last(blank(F.col("text")), True).over(left)))
    rows = rows.withColumn("second", F.when(F.col("r") == 1, F.last(F.coalesce(blank(F.col("text")), F.lag("first").over(up)), True).over(left)))
    meant = F.translate(F.col("text"), CONFUSED, MEANT)
    body = F.when(F.col("number_column") & F.col("text").rlike(r"\d") & numeric(meant), meant).otherwise(F.col("text"))
    text = F.when(F.col("body"), body).when(F.col("r") == 0, F.coalesce("first", F.lit(""))).otherwise(F.coalesce("second", F.lit("")))
    rows = rows.withColumn("text", text)
    above = F.lag("text").over(up)
    flat = F.when(above == F.col("text"), F.col("text")).otherwise(F.concat_ws("_", blank(above), blank(F.col("text"))))
    source = F.when(F.col("text") != "", F.col("confidence")).when(above != "", F.lag("confidence").over(up)).otherwise(F.col("confidence"))
    deep = F.col("depth") == 2
    merged = deep & (F.col("r") == 1)
    rows = rows.select("table_id", F.when(deep, F.col("r") - 1).otherwise(F.col("r")).alias("r"), "c", F.when(merged, flat).otherwise(F.col("text")).alias("text"), F.when(merged, source).otherwise(F.col("confidence")).alias("confidence")).where("r >= 0")
    one = F.lit(1)
    return _without_empty(rows).select("table_id", "r", "c", F.col("text").alias("content"), one.alias("row_span"), one.alias("col_span"), "confidence", F.lit(0).alias("ord"))


def table_cascade(cells: DataFrame, tasks: int | None = None, gathered: bool = False) -> DataFrame:
    """(table_id, tier0, tier1, resolved_tier, failed): the gate on the table as read and as restored. resolved_tier is
    the first to be accepted, null where a person has to look (the tiers of models are still ahead of that). A table that has
    no cell, or none left once restored, is for a person.
    """
    if _held(cells, gathered):
        both = _cascaded(_together(cells, tasks, gathered))
    else:
        cells = _dealt(cells, tasks)
        first = _gated(cells).select("table_id", F.col("decision").alias("tier0"), F.col("failed").alias("failed0"))
        both = first.join(_gated(_repaired(cells)).select("table_id", F.col("decision").alias("tier1"), F.col("failed").alias("failed1")), "table_id", "left")
    tier = F.when(F.col("tier0") == "ACCEPT", 0).when(F.col("tier1") == "ACCEPT", 1)
    return both.select("table_id", "tier0", F.coalesce("tier1", F.lit("HUMAN")).alias("tier1"), tier.alias("resolved_tier"), F.when(F.col("tier0") == "ACCEPT", F.col("failed0")).otherwise(F.coalesce("failed1", F.array(F.lit("TABLE_EMPTY")))).alias("failed"))
