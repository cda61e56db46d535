"""Tables through arrays: the same as through windows on odd tables, wide tables by windows still, and few steps on the cells."""

import random

from pyspark.sql import functions as F

from verdigris.operators import grids, tables
from verdigris.plans import catalogue

SF = "/root/testdata/sf0.001"
TEXTS = ["구분", "합계", "총계 ", "통계", "", "  ", None, "1", "1,234", "12O", "I0", "l|", "(5)", "5%", "2021", "2022", "2020 2023", "1999kg", "kWh", "원", "NaN", "inf", "-7", "100000", "99999999", "0.5", "a b", "subtotal", "1e400"]
SCHEMA = "table_id string, r int, c int, content string, row_span int, col_span int, confidence double, ord int"


def odd_cells(spark, n=300):
    """Spans that overlap or are null, rows and columns without a text, gaps, a table without a cell, totals and years."""
    rng, rows = random.Random(4), []
    for t in range(n):
        if t % 29 == 0:
            rows.append((f"t{t}", None, None, None, None, None, None, 0))
            continue
        height, width = rng.randint(1, 7), rng.randint(1, 5)
        kept = rng.choice([0.5, 0.9, 1.0])
        texts = TEXTS if t % 3 else TEXTS[7:9] + TEXTS[14:17] + TEXTS[1:2]
        for r in range(height):
            for c in range(width):
                if rng.random() < kept:
                    content = rng.choice(texts) if r and c else rng.choice(TEXTS[:8] + TEXTS[14:20])
                    rows.append((f"t{t}", r, c, content, rng.choice([1, 1, 1, 1, 2, 3, 0, None]), rng.choice([1, 1, 1, 1, 2, -1]), rng.choice([0.5, 0.9, 0.95, None]), len(rows)))
        rows.append((f"t{t}", height, 0, "합계", 1, 1, 0.9, len(rows)))
        rows.append((f"t{t}", height, width - 1, rng.choice(["3", "1,236", "10"]), 1, 1, 0.9, len(rows)))
    return spark.createDataFrame(rows, SCHEMA)


def test_arrays_and_windows_agree(spark, monkeypatch):
    cells = odd_cells(spark).cache()
    gate = lambda rows: {tuple(r[:4]) + (r.semantic, tuple(r.failed)) for r in rows.select("table_id", "decision", "hard", "soft", "semantic", "failed").collect()}
    slots = lambda rows: {(r.table_id, r.r, r.c): (r.content, r.confidence) for r in rows.collect()}
    by_windows = tables._dealt(cells, None)
    want = gate(tables._gated(by_windows)), slots(tables._repaired(by_windows))
    again = gate(tables._gated(tables._repaired(by_windows)))
    assert gate(tables.table_gate(cells, 3)) == want[0] and {f for *_, failed in want[0] for f in failed} == {*tables.SIGNALS, "TABLE_EMPTY"}
    assert slots(tables.restored(cells, 3)) == want[1] and len(want[1]) > 3000
    assert gate(tables._judged(tables._mended(tables._together(cells, 2, False)))) == again
    plain = tables.table_cascade(cells).orderBy("table_id").collect()
    monkeypatch.setattr(tables, "NARROW", (2, 2))
    assert tables.table_cascade(cells).orderBy("table_id").collect() == plain


def test_blocks_end_where_tables_do(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(grids, "BLOCK_CELLS", 5)
    ids = [0] * 3 + [1] * 14 + [2] + [None] * 2 + [3] * 6
    rows = pa.table({"table_id": pa.array(ids, pa.int64())})
    got = [b.column(0).to_pylist() for b in grids.blocks(iter(rows.to_batches(max_chunksize=2)))]
    assert sum(got, []) == ids and all(a[-1] != b[0] for a, b in zip(got, got[1:])) and len(got) > 2


def test_a_wide_table_goes_by_windows(spark):
    """One cell over 5,000 rows would not count as narrow: no task takes its slots into memory."""
    cells = spark.createDataFrame([("a", 0, 0, "x", 5000, 1, None, 0), ("a", 0, 1, "1", 1, 1, None, 1), ("b", 0, 0, "x", 1, 1, None, 0)], SCHEMA)
    assert not tables._held(cells, False) and tables._held(cells.where("table_id = 'b'"), False)
    assert {r.table_id: r.hard for r in tables.table_gate(cells).collect()} == {"a": 1, "b": 0}


def test_no_window_or_sort_on_cells(spark):
    """The plans had 12 windows, and 54 in the cascade."""
    for name, most in (("table_gate_signals", 1), ("table_gate_cascade", 1)):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") <= most and plan.count("Generate ") <= most


def test_cells_of_an_order_stand_together(spark):
    from verdigris.plans.tables import cells

    split = cells(spark, SF).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    runs = split.groupBy("table_id").agg(F.count_distinct("part").alias("parts"), (F.max("at") - F.min("at") + 1).alias("reach"), F.count(F.lit(1)).alias("n"))
    assert runs.where("parts > 1 OR reach > n").count() == 0
