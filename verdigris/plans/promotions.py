"""Suppliers' items before and after late evidence, the answers that follow, and where figures and places come from."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import promotion
from .registry import query, table
from .statements import SERIES_SQL, figures

# Items of the questionnaire: code, unit, whether the profile has it.
TAXONOMY = [("E-4-2", "TJ", True), ("E-6-1", "ton", True), ("E-5-1", "m3", True), ("E-6-2", "%", False), ("G-4-1", "", True), ("S-1-1", "", True)]
PRESENCE = [("P1", ["E-4-2"], False), ("P2", ["E-5-1", "E-6-2"], False), ("P3", ["S-1-1", "G-4-1"], True), ("P4", ["Z-1"], True), ("P5", ["E-6-1", "E-4-2"], False)]
OPTIONS = [("M1", [("환경", ["E-6-1", "E-4-2"]), ("물", ["E-5-1"]), ("윤리", ["G-4-1", "S-1-1"])]), ("M2", [("없음", ["Q-1"])])]
ITEMS_SQL = f"""
    f AS ({SERIES_SQL}), c AS (SELECT corp, max(period) AS period, sum(q) AS q FROM f GROUP BY corp),
    tax(code, unit, in_profile) AS (VALUES {", ".join(f"('{c}', '{u}', {str(p).lower()})" for c, u, p in TAXONOMY)}),
    items AS (SELECT corp, 'E-4-2' AS code, 'mapped' AS status, q::DOUBLE AS value, 'TJ' AS unit, 'filed' AS note, CASE WHEN corp % 2 = 1 THEN ['d:' || corp] ELSE [] END AS node_ids, corp % 2 = 0 AS no_evidence FROM c
        UNION ALL SELECT corp, 'E-6-1', CASE WHEN corp % 3 = 0 THEN 'missing' ELSE 'mapped' END, CASE WHEN corp % 3 > 0 THEN 1.5 END, CASE WHEN corp % 3 > 0 THEN 'ton' END, NULL, [], corp % 3 > 0 FROM c
        UNION ALL SELECT corp, x, 'missing', NULL, NULL, NULL, [], false FROM c, (VALUES ('E-5-1'), ('G-4-1'), ('S-1-1')) v(x)),
    late AS (SELECT corp, 'E-5-1' AS code, 'o:' || corp || ':E-5-1:' || period AS node_id, q::DOUBLE AS value, CASE WHEN corp % 4 = 0 THEN '' ELSE 'kL' END AS unit, period FROM f WHERE corp % 2 = 0
        UNION ALL SELECT corp, 'E-6-2', 'o:' || corp || ':E-6-2:' || period, n, NULL, period FROM f WHERE corp % 5 = 0
        UNION ALL SELECT corp, 'E-6-1', 'o:' || corp || ':E-6-1:' || period, n, 'kg', period FROM f WHERE corp % 4 = 1 UNION ALL SELECT corp, 'X-9', 'o:' || corp || ':X-9:' || period, n, 'kg', period FROM f),
    clauses AS (SELECT corp, 'G-4-1' AS code, 't:' || corp || ':G' AS node_id FROM c WHERE corp % 3 = 1 UNION ALL SELECT corp, 'E-6-1', 't:' || corp || ':E' FROM c WHERE corp % 7 = 0 UNION ALL SELECT corp, 'S-1-1', 'survey:' || corp || ':s1' FROM c WHERE corp % 4 > 1),
    e AS (SELECT corp, code, list(node_id ORDER BY period) AS e, arg_max(value, period * 100) AS v, arg_max(coalesce(unit, ''), period * 100) AS u FROM late GROUP BY ALL), s AS (SELECT corp, code, list(node_id) AS s FROM clauses GROUP BY ALL),
    keyed AS (SELECT corp, code FROM items UNION SELECT corp, code FROM e UNION SELECT corp, code FROM s),
    j AS (SELECT k.corp, k.code, i.status, i.value, i.unit, i.note, i.node_ids, i.no_evidence, e.e, e.v, e.u, s.s, t.unit AS tu, t.in_profile, i.status IS NOT NULL AS has, coalesce(i.status <> 'missing', false) AS shown, (e.e IS NOT NULL OR s.s IS NOT NULL) AND t.code IS NOT NULL AND coalesce(i.status = 'missing', true) AS lifts
        FROM keyed k LEFT JOIN items i USING (corp, code) LEFT JOIN e USING (corp, code) LEFT JOIN s USING (corp, code) LEFT JOIN tax t USING (code)),
    after AS (SELECT corp, code, CASE WHEN lifts THEN CASE WHEN in_profile THEN 'mapped' ELSE 'beyond' END ELSE status END AS status, CASE WHEN lifts THEN v ELSE value END AS value,
        CASE WHEN lifts THEN CASE WHEN e IS NOT NULL THEN coalesce(nullif(u, ''), tu) ELSE '' END ELSE unit END AS unit, CASE WHEN lifts AND e IS NULL THEN '{promotion.CLAUSE}' ELSE note END AS note,
        CASE WHEN shown OR lifts THEN coalesce(node_ids, []) || coalesce(e, []) || coalesce(s, []) ELSE coalesce(node_ids, []) END AS node_ids, coalesce(no_evidence, false) AND NOT (shown AND e IS NOT NULL) AS no_evidence, CASE WHEN lifts THEN CASE WHEN e IS NOT NULL THEN 'quantity' ELSE 'clause' END END AS promoted FROM j WHERE has OR lifts)"""


def items_after(spark, d):
    """The suppliers' items with the evidence, clauses and survey answers that came late."""
    f = figures(spark, d)
    c = f.groupBy("corp").agg(F.sum("q").alias("q"))
    corp, none = F.col("corp"), F.array().cast("array<string>")

    def item(code, status, value=None, unit=None, note=None, ids=none, bare=F.lit(False)):
        lit = lambda x: x if hasattr(x, "cast") else F.lit(x)
        return F.struct(F.lit(code).alias("code"), lit(status).alias("status"), lit(value).cast("double").alias("value"), lit(unit).cast("string").alias("unit"), lit(note).cast("string").alias("note"), ids.alias("node_ids"), bare.alias("no_evidence"))

    third = corp % 3 > 0
    own = F.array(
        item("E-4-2", "mapped", F.col("q"), "TJ", "filed", F.when(corp % 2 == 1, F.array(F.concat(F.lit("d:"), corp))).otherwise(none), corp % 2 == 0), item("E-6-1", F.when(third, "mapped").otherwise("missing"), F.when(third, 1.5), F.when(third, "ton"), None, none, third),
        item("E-5-1", "missing"), item("G-4-1", "missing"), item("S-1-1", "missing"),
    )
    items = c.select("corp", F.explode(own).alias("i")).select("corp", "i.*")
    node = lambda code, value, unit: F.struct(F.lit(code).alias("code"), F.concat_ws(":", F.lit("o"), corp, F.lit(code), "period").alias("node_id"), F.col(value).cast("double").alias("value"), unit.cast("string").alias("unit"))
    late = F.array_compact(F.array(F.when(corp % 2 == 0, node("E-5-1", "q", F.when(corp % 4 == 0, "").otherwise("kL"))), F.when(corp % 5 == 0, node("E-6-2", "n", F.lit(None))), F.when(corp % 4 == 1, node("E-6-1", "n", F.lit("kg"))), node("X-9", "n", F.lit("kg"))))
    evidence = f.select("corp", "period", F.explode(late).alias("x")).select("corp", "x.*", "period", F.lit(0.9).alias("confidence"), F.col("period").alias("ord"))
    clauses = c.where(corp % 3 == 1).select("corp", F.lit("G-4-1").alias("code"), F.concat(F.lit("t:"), corp, F.lit(":G")).alias("node_id"), F.lit(1).alias("ord"))
    clauses = clauses.unionByName(c.where(corp % 7 == 0).select("corp", F.lit("E-6-1").alias("code"), F.concat(F.lit("t:"), corp, F.lit(":E")).alias("node_id"), F.lit(1).alias("ord")))
    survey = c.select("corp", F.lit("s1").alias("qid"), F.lit("S-1-1").alias("code"), F.when(corp % 4 == 0, promotion.BLANK_ANSWER).when(corp % 4 == 1, "  ").otherwise("방침 있음").alias("text"), F.lit(2).alias("ord"))
    return promotion.promoted(items, spark.createDataFrame(TAXONOMY, "code string, unit string, in_profile boolean"), evidence, clauses.unionByName(promotion.survey_clauses(survey, ["corp"])), ["corp"])


@query(f"WITH {ITEMS_SQL} SELECT corp, code, status, value, unit, note, array_to_string(node_ids, ',') AS node_ids, no_evidence, promoted FROM after")
def promoted_items(spark, d):
    """Items lifted by late evidence, by clauses and by survey answers."""
    return items_after(spark, d).withColumn("node_ids", F.array_join("node_ids", ","))


def _asked(spark, d, rows, schema):
    return figures(spark, d).select("corp").distinct().withColumn("_q", F.explode(F.from_json(F.lit(rows), f"array<struct<{schema}>>"))).select("corp", "_q.*")


@query(f"""WITH {ITEMS_SQL}, q(qid, codes, narrative) AS (VALUES {", ".join(f"('{q}', {c}, {str(n).lower()})" for q, c, n in PRESENCE)}),
    m AS (SELECT c.corp, qid, narrative, list(a.code ORDER BY list_position(codes, a.code)) FILTER (a.code IS NOT NULL) AS present, flatten(list(a.node_ids ORDER BY list_position(codes, a.code)) FILTER (a.code IS NOT NULL)) AS ids FROM c CROSS JOIN q LEFT JOIN after a ON a.corp = c.corp AND list_contains(codes, a.code) AND a.status <> 'missing' GROUP BY ALL)
    SELECT corp, qid, coalesce(array_to_string(present, ','), '') AS present, coalesce(array_to_string(ids, ','), '') AS node_ids, CASE WHEN present IS NULL THEN CASE WHEN narrative THEN 'hitl_required' ELSE 'insufficient' END WHEN len(ids) > 0 THEN 'verified' ELSE 'self_reported' END AS status FROM m""")
def presence_answers(spark, d):
    """Whether the suppliers show what each question asks for, and on what evidence."""
    asked = _asked(spark, d, json.dumps([{"qid": q, "codes": c, "narrative": n} for q, c, n in PRESENCE]), "qid:string,codes:array<string>,narrative:boolean")
    got = promotion.presence_answers(asked, items_after(spark, d), ["corp"])
    return got.select("corp", "qid", F.array_join("present", ",").alias("present"), F.array_join("node_ids", ",").alias("node_ids"), "status")


@query(f"""WITH {ITEMS_SQL}, o(qid, i, label, codes) AS (VALUES {", ".join(f"('{q}', {i}, '{label}', {codes})" for q, options in OPTIONS for i, (label, codes) in enumerate(options))}),
    m AS (SELECT c.corp, qid, i, label, count(a.code) AS n, flatten(list(a.node_ids ORDER BY list_position(codes, a.code)) FILTER (a.code IS NOT NULL)) AS ids FROM c CROSS JOIN o LEFT JOIN after a ON a.corp = c.corp AND list_contains(codes, a.code) AND a.status <> 'missing' GROUP BY ALL),
    g AS (SELECT corp, qid, coalesce(string_agg(label, ',' ORDER BY i) FILTER (n > 0), '') AS ticked, coalesce(string_agg(label, ',' ORDER BY i) FILTER (n = 0), '') AS open, coalesce(array_to_string(flatten(list(ids ORDER BY i) FILTER (ids IS NOT NULL)), ','), '') AS node_ids FROM m GROUP BY corp, qid)
    SELECT *, CASE WHEN ticked = '' THEN 'insufficient' WHEN node_ids <> '' THEN 'verified' ELSE 'self_reported' END AS status FROM g""")
def multi_select_answers(spark, d):
    """Options that the suppliers' items tick, and those that stay open."""
    asked = _asked(spark, d, json.dumps([{"qid": q, "options": [{"label": label, "codes": c} for label, c in o]} for q, o in OPTIONS]), "qid:string,options:array<struct<label:string,codes:array<string>>>")
    got = promotion.multi_select_answers(asked, items_after(spark, d), ["corp"])
    return got.select("corp", "qid", F.array_join("ticked", ",").alias("ticked"), F.array_join("open", ",").alias("open"), F.array_join("node_ids", ",").alias("node_ids"), "status")


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT corp || ':' || code AS point_id, trim(coalesce(trunc(value)::BIGINT::VARCHAR, '') || ' ' || coalesce(unit, '')) AS claim, node_ids FROM after WHERE status <> 'missing'),
    l AS (SELECT point_id, unnest(node_ids) AS node_id, generate_subscripts(node_ids, 1) AS i FROM p), k AS (SELECT l.*, starts_with(node_id, 'o:') AND coalesce(TRY_CAST(right(node_id, 1) AS INT) % 2 = 0, false) AS placed, starts_with(node_id, 'o:') AS known FROM l QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY placed DESC, i) = 1),
    x AS (SELECT point_id, claim, node_id, CASE WHEN known THEN CASE WHEN TRY_CAST(right(node_id, 1) AS INT) % 3 = 0 THEN 'scan' ELSE 'bill-' || right(node_id, 4) || '.pdf' END ELSE node_id END AS file, coalesce(placed, false) AS placed FROM p LEFT JOIN k USING (point_id))
    SELECT point_id, 1 AS step, 'claim' AS key, coalesce(nullif(claim, ''), '—') AS value, NULL::BOOLEAN AS linked FROM x UNION ALL SELECT point_id, 2, 'node', coalesce(node_id, '—'), NULL FROM x UNION ALL SELECT point_id, 3, 'source', coalesce(file, '—'), NULL FROM x UNION ALL SELECT point_id, 4, 'location', CASE WHEN placed THEN 'bbox 연결됨' ELSE '좌표 미연결' END, placed FROM x""")
def provenance_steps(spark, d):
    """Four steps from each figure to its place in a document."""
    points = items_after(spark, d).where("status <> 'missing'").select(F.concat_ws(":", "corp", "code").alias("point_id"), F.col("value").cast("long").cast("string").alias("value"), "unit", "node_ids")
    f = figures(spark, d)
    year = F.col("period")
    codes = F.explode(F.array(*map(F.lit, ("E-5-1", "E-6-2", "E-6-1")))).alias("code")
    nodes = f.select("corp", "period", codes).select(F.concat_ws(":", F.lit("o"), "corp", "code", "period").alias("node_id"), F.when(year % 10 % 3 == 0, "").otherwise(F.concat(F.lit("bill-"), year, F.lit(".pdf"))).alias("file"), F.lit("scan").alias("source"), F.lit("ocr").alias("origin"), F.when(year % 2 == 0, F.array(*map(F.lit, (0.1, 0.1, 0.2, 0.2)))).alias("box"))
    return promotion.provenance(points, nodes)


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS ord, 'L' || l_linenumber AS label, (l_quantity::BIGINT % 4)::DOUBLE AS value FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1),
    m AS (SELECT doc, ord, CASE WHEN ord % 3 = 0 THEN label ELSE 'x' END AS hint, value, ord % 5 = 0 AS has FROM l), v AS (SELECT *, row_number() OVER (PARTITION BY doc, value ORDER BY ord) AS k FROM l),
    o AS (SELECT doc, ord, value, row_number() OVER (PARTITION BY doc, value ORDER BY ord) AS k FROM m WHERE NOT has AND hint = 'x')
    SELECT m.doc, m.ord, CASE WHEN has THEN -1 WHEN hint <> 'x' THEN m.ord ELSE v.ord END::INT AS place, CASE WHEN has THEN NULL WHEN hint <> 'x' THEN m.ord + 100 ELSE v.ord + 100 END::INT AS page
    FROM m LEFT JOIN o ON o.doc = m.doc AND o.ord = m.ord LEFT JOIN v ON v.doc = o.doc AND v.value = o.value AND v.k = o.k""")
def geometry_attached(spark, d):
    """Places given back to figures: by label, else one to one among equal values in reading order."""
    o = F.col("l_linenumber").cast("int")
    once = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    lines = table(spark, d, "lineitem").withColumn("_n", once).where("_n = 1").select(F.col("l_orderkey").alias("doc"), o.alias("ord"), F.concat(F.lit("L"), o).alias("label"), (F.col("l_quantity").cast("long") % 4).cast("double").alias("value"))
    pairs = lines.withColumns({"box": F.array("ord"), "page": F.col("ord") + 100})
    metrics = lines.select("doc", "ord", F.when(F.col("ord") % 3 == 0, F.col("label")).otherwise("x").alias("hint"), "value", F.when(F.col("ord") % 5 == 0, F.array(F.lit(-1))).alias("box"), F.lit(None).cast("int").alias("page"))
    return promotion.with_geometry(metrics, pairs).select("doc", "ord", F.get("box", F.lit(0)).alias("place"), "page")
