"""Late evidence, answers, provenance and geometry on small tables."""

from verdigris.operators import promotion

ITEMS = "corp long, code string, status string, value double, unit string, note string, node_ids array<string>, no_evidence boolean"
EVIDENCE = "corp long, code string, node_id string, value double, unit string, period int, confidence double, ord int"
CLAUSES = "corp long, code string, node_id string, ord int"


def tables(spark):
    items = spark.createDataFrame([(1, "A", "mapped", 5.0, "t", "own", ["d1"], True), (1, "B", "missing", None, None, None, None, False), (1, "C", "missing", None, None, None, [], False), (1, "D", "mapped", 1.0, "%", None, [], True), (2, "A", "missing", None, None, None, [], False)], ITEMS)
    taxonomy = spark.createDataFrame([("A", "t", True), ("B", "kg", True), ("C", "", True), ("D", "%", True), ("E", "u", False)], "code string, unit string, in_profile boolean")
    evidence = spark.createDataFrame([(1, "A", "o1", 9.0, "t", 2023, 0.9, 1), (1, "A", "d1", 9.0, "t", 2023, 0.9, 0), (1, "B", "o2", 2.0, "", 2022, 0.9, 2), (1, "B", "o3", 3.0, None, 2023, 0.5, 3), (1, "B", "o4", 4.0, "kg", 2023, 0.5, 4), (1, "E", "o5", 7.0, "x", 2020, 0.1, 5), (1, "?", "o6", 7.0, "x", 2020, 0.1, 6)], EVIDENCE)
    clauses = spark.createDataFrame([(1, "C", "t1", 1), (1, "A", "t2", 1), (1, "D", "t3", 1), (3, "?", "t4", 1)], CLAUSES)
    return items, taxonomy, evidence, clauses


def test_promoted(spark):
    items, *rest = tables(spark)
    found = promotion.promoted(items, *rest, ["corp"])
    got = {(r.corp, r.code): (r.status, r.value, r.unit, r.note, r.node_ids, r.no_evidence, r.promoted) for r in found.collect()}
    assert got == {
        (1, "A"): ("mapped", 5.0, "t", "own", ["d1", "o1", "t2"], False, None), (1, "B"): ("mapped", 4.0, "kg", None, ["o2", "o3", "o4"], False, "quantity"), (1, "C"): ("mapped", None, "", promotion.CLAUSE, ["t1"], False, "clause"),
        (1, "D"): ("mapped", 1.0, "%", None, ["t3"], True, None), (1, "E"): ("beyond", 7.0, "x", None, ["o5"], False, "quantity"), (2, "A"): ("missing", None, None, None, [], False, None),
    }
    again = {(r.corp, r.code): tuple(r)[:-1] for r in promotion.promoted(found.drop("promoted"), *rest, ["corp"]).collect()}
    assert again == {(r.corp, r.code): tuple(r)[:-1] for r in found.collect()}  # a replay ends in the same state
    none = [x.where("false") for x in rest[1:]]
    assert {r.promoted for r in promotion.promoted(items, rest[0], *none, ["corp"]).collect()} == {None}


def test_answers(spark):
    items, *rest = tables(spark)
    after = promotion.promoted(items, *rest, ["corp"])
    asked = spark.createDataFrame([(1, "p", ["C", "A", "Z"], False), (1, "n", ["Z"], True), (2, "p", ["A"], False), (9, "p", ["A"], None)], "corp long, qid string, codes array<string>, narrative boolean")
    got = {(r.corp, r.qid): (r.present, r.node_ids, r.status) for r in promotion.presence_answers(asked, after, ["corp"]).collect()}
    assert got == {(1, "p"): (["C", "A"], ["t1", "d1", "o1", "t2"], "verified"), (1, "n"): ([], [], "hitl_required"), (2, "p"): ([], [], "insufficient"), (9, "p"): ([], [], "insufficient")}
    options = spark.createDataFrame([(1, "m", [("x", ["Z", "B"]), ("y", ["Z"])]), (2, "m", [("x", ["A"])])], "corp long, qid string, options array<struct<label:string,codes:array<string>>>")
    got = {r.corp: (r.ticked, r.open, r.node_ids, r.status) for r in promotion.multi_select_answers(options, after, ["corp"]).collect()}
    assert got[1] == (["x"], ["y"], ["o2", "o3", "o4"], "verified") and got[2] == ([], ["x"], [], "insufficient")
    survey = spark.createDataFrame([(1, "q", "A", t, 1) for t in (None, "", " 미입력 ", "yes")], "corp long, qid string, code string, text string, ord int")
    assert [r.node_id for r in promotion.survey_clauses(survey, ["corp"]).collect()] == ["survey:1:q"]


def test_provenance(spark):
    points = spark.createDataFrame([(1, "5", "t", ["a", "b"]), (2, None, None, []), (3, "7", None, ["raw"]), (4, "1", "%", None)], "point_id long, value string, unit string, node_ids array<string>")
    nodes = spark.createDataFrame([("a", "", "s.xml", "dart", None), ("b", "bill.pdf", "s", "ocr", [0.1])], "node_id string, file string, source string, origin string, box array<double>")
    got = {}
    for r in promotion.provenance(points, nodes).collect():
        got.setdefault(r.point_id, {})[r.step] = (r.key, r.value, r.linked)
    assert [got[1][i] for i in (1, 2, 3, 4)] == [("claim", "5 t", None), ("node", "b", None), ("source", "bill.pdf", None), ("location", "bbox 연결됨", True)]
    assert [got[2][i][1] for i in (1, 2, 3, 4)] == ["—", "—", "—", "좌표 미연결"] and [got[3][i][1] for i in (2, 3)] == ["raw", "raw"] and got[4][2][1] == "—"


def test_geometry(spark):
    """Labels first; then one to one among equal values in reading order, and nothing once pairs run out."""
    pairs = spark.createDataFrame([(1, 1, "x", "5", [1.0], 1), (1, 2, "y", "5.0", [2.0], 2), (1, 3, "z", "n/a", [3.0], 3)], "doc long, ord int, label string, value string, box array<double>, page int")
    metrics = spark.createDataFrame([(1, 1, "q", 5.0, None, None), (1, 2, "z", 5.0, None, 9), (1, 3, "q", 5.0, [0.0], None), (1, 4, "q", 5.0, None, None), (1, 5, "q", 5.0, None, None), (2, 1, "x", 5.0, None, None), (1, 6, "q", None, None, None)], "doc long, ord int, hint string, value double, box array<double>, page int")
    got = {(r.doc, r.ord): (r.box, r.page) for r in promotion.with_geometry(metrics, pairs).collect()}
    assert got == {(1, 1): ([1.0], 1), (1, 2): ([3.0], 9), (1, 3): ([0.0], None), (1, 4): ([2.0], 2), (1, 5): (None, None), (2, 1): (None, None), (1, 6): (None, None)}
