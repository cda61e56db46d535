"""Overrides by industry, and gold cases that are the same on any partitioning."""

from pyspark.sql import functions as F

from verdigris.operators import goldsets, industry

REGISTRY = [industry.IndustryModule("a", ("Auto Parts",), {"vague": ("x", "y")}, {"w": {"p": 9.0, "q": 8.0}}, {"full": 4.0}), industry.IndustryModule("b", ("parts",), scalars={"full": 2.0}), industry.IndustryModule("c")]


def test_module_of(spark):
    rows = [("a", None, "a"), ("zz", "auto parts", None), (None, " AUTOPARTS maker", "a"), ("", "spare Parts", "b"), (None, None, None), (None, "bank", None), ("c", "auto parts", "c")]
    df = spark.createDataFrame(rows, "active string, told string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", industry.module_of(F.col("active"), F.col("told"), REGISTRY)).collect())
    assert {r.got for r in df.withColumn("got", industry.module_of(F.col("active"), F.col("told"), [])).collect()} == {None}


def test_merges(spark):
    m = F.col("m")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "m string")
    merged = industry.merged_map(m, "w", {"p": 1.0, "r": 2.0}, REGISTRY)
    got = {r.m: (r.full, r.terms, r.p, r.q, r.r) for r in df.select("m", industry.scalar(m, "full", 1.0, REGISTRY).alias("full"), industry.merged_terms(m, "vague", ["y", "z", "y"], REGISTRY).alias("terms"), *[c.alias(k) for k, c in merged.items()]).collect()}
    assert got == {"a": (4.0, ["y", "z", "x"], 9.0, 8.0, 2.0), "b": (2.0, ["y", "z"], 1.0, None, 2.0), "c": (1.0, ["y", "z"], 1.0, None, 2.0), None: (1.0, ["y", "z"], 1.0, None, 2.0)}


def test_cases(spark):
    facts = [("f1", "c1", "E-1", "배출량 ", 0.0, True, "톤"), ("f2", "c2", "E-2", "비율", 9.95, False, "%"), ("f3", "c3", "E-3", None, 1234.5, False, None), ("f4", "c4", "E-4", "x", None, True, "톤"), ("f5", "c5", "E-5", "y", 40.0, False, "TJ")]
    df = spark.createDataFrame(facts, "fact_id string, chunk_id string, code string, note string, value double, whole boolean, unit string")
    got = {r.case_id: (r.answer, r.faithful, r.hallucinated, r.uncited) for r in goldsets.grounding_cases(df).collect()}
    assert got == {r.case_id: (r.answer, r.faithful, r.hallucinated, r.uncited) for r in goldsets.grounding_cases(df.repartition(7, "unit")).collect()}
    assert len(got) == 16 and got["f1:faithful"] == ("배출량은 0 톤입니다 [c1]", True, [], False) and got["f1:numeric"] == ("배출량은 1 톤입니다 [c1]", False, ["1"], False)
    assert got["f2:numeric"] == ("비율은 10.05 %입니다 [c2]", False, ["10.05"], False) and got["f2:citation"] == ("비율은 9.95 %입니다", False, [], True)
    assert got["f3:numeric"][0] == "은 1,296.225입니다 [c3]" and got["f5:numeric"][2] == ["42"] and " 톤입니다" not in got["f1:unit"][0]


def test_scenarios(spark):
    """An orphan shown by a later fold step comes back; what it needs goes."""
    df = spark.createDataFrame([(1, ["A"], ["R", "B"]), (2, None, None), (3, ["A", "A", "C"], [])], "case_id long, omit array<string>, orphans array<string>")
    got = {r.case_id: (r.disclosed, r.missing) for r in goldsets.disclosure_cases(df, ["A", "B", "C"], {"R": ["B"]}).collect()}
    assert got == {1: (["B", "C", "R"], ["A", "B"]), 2: (["A", "B", "C"], []), 3: (["B"], ["A", "C"])}
