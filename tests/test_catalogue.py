"""Each plan against its SQL in DuckDB on the small tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from verdigris.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.ORACLE_SQL:
        cur = con.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_alike_parts_of_other_brands(spark, tmp_path):
    """Partners of another brand and by letters are found; two that are equally near give none."""
    rows = [(1, "A", "small widget"), (2, "B", "small widgets"), (3, "A", "copper bolt"), (4, "B", "copper bolt"), (5, "C", "tin ringa"), (6, "D", "tin ringb"), (7, "E", "tin ringc"), (8, "F", "q"), (9, "F", None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.a: (r.b, r.jaccard, r.method) for r in catalogue.QUERIES["bigram_jaccard_resolved"](spark, str(tmp_path)).collect()}
    none = (None, None, "none")
    assert got == {1: (2, round(11 / 12, 6), "fuzzy"), 2: (1, round(11 / 12, 6), "fuzzy"), 3: (4, 1.0, "exact"), 4: (3, 1.0, "exact"), **dict.fromkeys((5, 6, 7, 8, 9), none)}
