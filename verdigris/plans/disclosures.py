"""Suppliers as companies that disclose some of what is expected of them: the evidence graph, selective disclosure,
questionnaires and their gates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosure, evidence_graph
from ..operators.disclosure import ALERTS, CONTEXT, RATES, REQUIRED, SENSITIVITY
from .registry import query, table
from .statements import SERIES_SQL, figures

PROFILE = ["E-2-1", "E-2-2", "E-3-1", "E-3-2", "E-4-1", "E-4-2", "E-5-1", "E-5-2", "E-6-1", "E-6-2", "E-8-1", "S-2-3", "S-4-2", "G-4-1", "G-6-1"]
CODES_SQL = ", ".join(f"({i}, '{c}')" for i, c in enumerate(PROFILE))
COMPANY_SQL = f"""
    codes(i, code) AS (VALUES {CODES_SQL}),
    expected AS (SELECT s_suppkey AS corp, i, code FROM supplier, codes),
    reported AS (SELECT corp, i, code, ((corp * 13 + i * 17) % 150)::DOUBLE AS value, CASE WHEN i % 3 = 0 THEN '%' ELSE 'ton' END AS unit FROM expected WHERE (corp * 7 + i * i * 3 + i) % 4 <> 0
                 UNION ALL SELECT s_suppkey, 99, 'X-1-1', 1.0, 'ton' FROM supplier WHERE s_suppkey % 6 = 0),
    status AS (SELECT corp, code, CASE WHEN e.i IS NULL THEN 'beyond' WHEN r.i IS NULL THEN 'missing' ELSE 'mapped' END AS status, r.value, r.unit FROM expected e FULL JOIN reported r USING (corp, code))"""


def company_items(spark, d):
    corps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("corp"))
    expected = corps.select("corp", F.posexplode(F.array(*map(F.lit, PROFILE))).alias("i", "code"))
    corp, i = F.col("corp"), F.col("i")
    shown = expected.where((corp * 7 + i * i * 3 + i) % 4 != 0).select("corp", "code", ((corp * 13 + i * 17) % 150).cast("double").alias("value"), F.when(i % 3 == 0, "%").otherwise("ton").alias("unit"))
    beyond = corps.where("corp % 6 = 0").select("corp", F.lit("X-1-1").alias("code"), F.lit(1.0).alias("value"), F.lit("ton").alias("unit"))
    return expected, disclosure.item_status(expected, shown.unionByName(beyond), ["corp"])


@query(f"WITH {COMPANY_SQL} SELECT corp, code, status, value, unit FROM status")
def disclosed_items(spark, d):
    """Expected items mapped or missing, and items beyond what is expected."""
    return company_items(spark, d)[1]


@query(f"WITH {COMPANY_SQL} SELECT corp, CASE WHEN grouping(substr(code, 1, 1)) = 0 THEN substr(code, 1, 1) END AS area, count(*) FILTER (status = 'mapped') AS present, count(*) AS expected, round(100.0 * count(*) FILTER (status = 'mapped') / count(*), 1)::DOUBLE AS pct FROM status WHERE status <> 'beyond' GROUP BY GROUPING SETS ((corp, substr(code, 1, 1)), (corp))")
def coverage_by_area(spark, d):
    return disclosure.coverage(company_items(spark, d)[1], ["corp"])


WEIGHTS_SQL = ", ".join(f"('{c}', {w}, {i})" for i, (c, w) in enumerate(SENSITIVITY.items()))
PAIRS_SQL = ", ".join(f"('{r}', '{c}', {i})" for i, (r, cs) in enumerate(CONTEXT.items()) for c in cs)
D6_SQL = f"""{COMPANY_SQL}, w(code, weight, k) AS (VALUES {WEIGHTS_SQL}), p(ratio, needs, k) AS (VALUES {PAIRS_SQL}),
    a AS (SELECT corp, sum(CASE WHEN status = 'missing' THEN weight ELSE 0 END)::DOUBLE / sum(weight)::DOUBLE AS a, count(*) FILTER (status = 'missing') AS n_omitted, list(code ORDER BY weight DESC, k) FILTER (status = 'missing') AS omitted FROM status JOIN w USING (code) WHERE status <> 'beyond' GROUP BY corp),
    o AS (SELECT r.corp, p.ratio FROM p JOIN status r ON r.code = p.ratio AND r.status = 'mapped' JOIN status m ON m.corp = r.corp AND m.code = p.needs AND m.status = 'missing' GROUP BY ALL),
    b AS (SELECT corp, count(*) AS n FROM o GROUP BY corp),
    f AS (SELECT corp, count(DISTINCT ratio) AS favourable FROM status JOIN p ON ratio = code WHERE status = 'mapped' GROUP BY corp),
    d6 AS (SELECT corp, round(round(least(1.0, 0.45 * a + 0.55 * least(1.0, coalesce(n, 0) / {len(CONTEXT)}.0 * 2.0))::DOUBLE, 9) + 1e-9::DOUBLE, 4) AS score, coalesce(favourable, 0) AS favourable, n_omitted, omitted, coalesce(n, 0) AS n_orphans,
        (SELECT min(code) FROM status s WHERE s.corp = a.corp AND s.status = 'missing' AND code IN ({', '.join(f"'{c}'" for c in REQUIRED)})) AS required_omission FROM a LEFT JOIN b USING (corp) LEFT JOIN f USING (corp))"""


@query(f"WITH {D6_SQL} SELECT corp, score, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'medium' ELSE 'high' END AS level, favourable, n_omitted, coalesce(array_to_string(omitted[1:3], ','), '') AS top_omitted, n_orphans, required_omission FROM d6")
def selective_disclosure_report(spark, d):
    """Score, level and signals of selective disclosure of each company."""
    r = disclosure.selective_disclosure(company_items(spark, d)[1], ["corp"])
    return r.select("corp", "score", "level", F.col("favourable").cast("long").alias("favourable"), F.col("n_omitted").cast("long").alias("n_omitted"), F.array_join(F.slice("omitted", 1, 3), ",").alias("top_omitted"), F.size("orphans").cast("long").alias("n_orphans"), "required_omission")


# Every even item is asked for; some answers have proven data points, some are claimed by the company itself.
ISSB = [(c, "S2" if i % 2 else "S1", ["climate", "governance", "greenwash_defense", "supply"][i % 4], i) for i, c in enumerate(PROFILE) if i % 5 != 4] + [("E-3-1", "S2", "climate", 20), ("E-4-1", "S2", "climate", 21), ("E-4-1", "S1", "metrics", 22)]
ISSB_SQL = ", ".join(f"('{c}', '{s}', '{a}', {k})" for c, s, a, k in ISSB)
ANSWERS_SQL = f"""{D6_SQL},
    q AS (SELECT corp, i, code, 'Q' || i AS qid FROM expected WHERE i % 2 = 0),
    pt AS (SELECT corp, code, value + corp % 5 AS value, unit, CASE (corp + i) % 9 WHEN 0 THEN 'verified' WHEN 3 THEN 'unverified' ELSE 'estimated' END AS verification FROM reported WHERE (corp + i) % 3 = 0),
    cl AS (SELECT corp, code, ((corp * 11 + i * 17) % 150)::DOUBLE AS claimed, CASE WHEN i % 4 = 0 THEN '%' ELSE 'ton' END AS claimed_unit FROM expected WHERE corp % 2 = 0),
    m AS (SELECT q.corp, q.qid, q.code, coalesce(pt.value, s.value) AS value, CASE WHEN pt.value IS NOT NULL THEN pt.unit ELSE s.unit END AS unit, cl.claimed, cl.claimed_unit,
        CASE WHEN pt.value IS NOT NULL THEN CASE verification WHEN 'verified' THEN 'verified' WHEN 'unverified' THEN 'flagged' ELSE 'self_reported' END WHEN s.value IS NOT NULL THEN 'self_reported' ELSE 'insufficient' END AS first
        FROM q LEFT JOIN pt USING (corp, code) LEFT JOIN status s ON s.corp = q.corp AND s.code = q.code AND s.status = 'mapped' LEFT JOIN cl ON cl.corp = q.corp AND cl.code = q.code),
    w2 AS (SELECT *, CASE WHEN claimed IS NULL THEN NULL WHEN value IS NULL THEN 'unlinked' WHEN code IN ({', '.join(f"'{c}'" for c in RATES)}) AND unit <> '%' AND NOT value BETWEEN 0 AND 100 THEN 'rate_out_of_range'
        WHEN claimed_unit = '%' AND unit <> '%' AND code NOT IN ({', '.join(f"'{c}'" for c in RATES)}) THEN 'no_rate' WHEN round(abs(claimed - value), 1) >= 10 THEN 'discrepancy' ELSE 'agrees' END AS claim FROM m),
    answers AS (SELECT corp, qid, code, coalesce(value, claimed) AS value, CASE WHEN claim = 'unlinked' THEN 'self_reported' WHEN claim IN ('rate_out_of_range', 'no_rate', 'discrepancy') THEN 'flagged' ELSE first END AS status, claim FROM w2),
    map(code, standard, anchor, k) AS (VALUES {ISSB_SQL}),
    irows AS (SELECT corp, code, bool_or(anchor IN ({', '.join(f"'{a}'" for a in ALERTS)})) AS alert, status FROM status JOIN map USING (code) GROUP BY ALL),
    g AS (SELECT a.*, CASE WHEN o.ratio IS NOT NULL THEN 'orphan_ratio' WHEN list_contains(d6.omitted, a.code) AND a.status = 'insufficient' THEN 'sensitive_omission' WHEN i.alert THEN 'issb_alert' WHEN i.corp IS NOT NULL AND a.status = 'insufficient' THEN 'issb_note' END AS gate
        FROM answers a LEFT JOIN o ON o.corp = a.corp AND o.ratio = a.code LEFT JOIN d6 ON d6.corp = a.corp LEFT JOIN irows i ON i.corp = a.corp AND i.code = a.code AND i.status = 'missing'),
    final AS (SELECT corp, qid, code, value, claim, gate, CASE WHEN gate IN ('orphan_ratio', 'issb_alert') THEN 'flagged' ELSE status END AS status FROM g)"""


def questionnaire(spark, d):
    expected, status = company_items(spark, d)
    corp, i = F.col("corp"), F.col("i")
    questions = expected.where("i % 2 = 0").select("corp", F.concat(F.lit("Q"), "i").alias("qid"), "code")
    shown = expected.join(status.where("status = 'mapped'").select("corp", "code", "value", "unit"), ["corp", "code"]).where((corp + i) % 3 == 0)
    kind = F.when((corp + i) % 9 == 0, "verified").when((corp + i) % 9 == 3, "unverified").otherwise("estimated")
    points = shown.select("corp", "code", (F.col("value") + corp % 5).alias("value"), "unit", kind.alias("verification"))
    claims = expected.where("corp % 2 = 0").select("corp", "code", ((corp * 11 + i * 17) % 150).cast("double").alias("claimed"), F.when(i % 4 == 0, "%").otherwise("ton").alias("claimed_unit"))
    answers = disclosure.numeric_answers(questions, status, points, claims, ["corp"])
    mapping = spark.createDataFrame(ISSB, "code string, standard string, anchor string, ord int")
    rows = disclosure.issb_rows(mapping, status, ["corp"])
    missing = rows.where("status = 'missing' AND scope = 'in_profile'")
    return disclosure.gated(answers, disclosure.selective_disclosure(status, ["corp"]), missing, ["corp"]), rows


@query(f"WITH {ANSWERS_SQL} SELECT corp, qid, code, value, status, claim, gate FROM final")
def questionnaire_answers(spark, d):
    """Answers from data points and reports, held against claims, after the gates."""
    return questionnaire(spark, d)[0].select("corp", "qid", "code", "value", "status", "claim", "gate")


@query(f"WITH {ANSWERS_SQL} SELECT status, CASE status WHEN 'insufficient' THEN 'upload_evidence' WHEN 'flagged' THEN 'explain' ELSE 'link_evidence' END AS action, count(*) AS n FROM final WHERE status <> 'verified' GROUP BY ALL")
def questionnaire_gaps(spark, d):
    return disclosure.gaps(questionnaire(spark, d)[0], ["corp"]).groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ANSWERS_SQL}, anchored AS (SELECT DISTINCT corp, code, status, anchor FROM status JOIN map USING (code))
    SELECT corp, anchor, count(*) AS n_items, count(*) FILTER (status = 'missing') AS n_missing FROM anchored GROUP BY ALL""")
def issb_gap_by_anchor(spark, d):
    """Mapped items and those missing, under each anchor."""
    return disclosure.issb_by_anchor(questionnaire(spark, d)[1], ["corp"])


# What is reported of energy, and sentences that say how it changed.
GRAPH_SQL = f"""
    f AS ({SERIES_SQL}),
    nodes AS (SELECT corp, corp || '_E-4-1_' || period AS node_id, 'E-4-1' AS metric, q::DOUBLE AS value, CASE WHEN corp % 2 = 0 THEN 'kWh' ELSE 'MJ' END AS unit, period FROM f),
    said AS (SELECT corp, period, 1 AS ord, (corp % 7 + 1) + 0.5 AS pct, corp % 2 = 1 AS points, period % 2 = 0 AS down FROM f UNION ALL SELECT corp, period, 2, 3.0, false, false FROM f WHERE corp % 3 = 0),
    met AS (SELECT s.*, n.node_id AS target_id, n.unit, CASE WHEN down THEN -pct ELSE pct END::DOUBLE AS yoy, CASE WHEN points THEN n.value - yoy ELSE n.value / (1 + yoy / 100) END AS prior, corp || '_E-4-1_' || (period - 1) || '_inferred' AS source_id FROM said s JOIN nodes n USING (corp, period))"""


def energy(spark, d):
    f = figures(spark, d)
    node = F.concat_ws("_", "corp", F.lit("E-4-1"), "period")
    nodes = f.select("corp", node.alias("node_id"), F.lit("E-4-1").alias("metric"), F.col("q").cast("double").alias("value"), F.when(F.col("corp") % 2 == 0, "kWh").otherwise("MJ").alias("unit"), "period", F.lit("report").alias("origin"), F.lit(None).cast("string").alias("source_file"), F.lit(1.0).alias("confidence"), F.lit(0).alias("ord"))
    first = F.concat(F.lit("에너지 사용량은 전년 대비 "), F.col("corp") % 7 + 1, F.lit(".5%"), F.when(F.col("corp") % 2 == 1, "p").otherwise(""), F.lit(" "), F.when(F.col("period") % 2 == 0, "감소").otherwise("증가"))
    snippets = f.select("corp", "period", F.lit(1).alias("ord"), first.alias("text")).unionByName(f.where("corp % 3 = 0").select("corp", "period", F.lit(2).alias("ord"), F.lit("에너지사용은 전년 대비 각각 3.0%, 2% 상승했다").alias("text")))
    return nodes, snippets


@query(f"WITH {GRAPH_SQL} SELECT source_id AS node_id, arg_min(round(prior, 4), ord) AS value, any_value(unit) AS unit, any_value(period) - 1 AS period, count(*) AS n_edges, sum(round(yoy, 3)) AS yoy FROM met GROUP BY source_id")
def inferred_prior_figures(spark, d):
    """Figures of the year before, worked out from text, with the edges that lead from them."""
    priors, edges = evidence_graph.inferred_priors(*energy(spark, d), ["corp"])
    e = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("yoy").alias("yoy"))
    return priors.select("node_id", "value", "unit", "period").join(e, "node_id")


ORIGINS_SQL = """
    o AS (SELECT l_suppkey AS corp, CAST(year(l_shipdate) AS INT) AS period, CASE l_returnflag WHEN 'N' THEN 'dart' WHEN 'R' THEN 'ocr' ELSE 'survey' END AS origin, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS ord, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
    nodes AS (SELECT corp, period, origin, ord, value, origin || ':' || corp || ':' || period AS node_id, CASE ord WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.9 END AS confidence FROM o WHERE NOT (origin = 'dart' AND corp % 2 = 0))"""


def origins(spark, d):
    flag = F.col("l_returnflag")
    o = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("corp"), F.year("l_shipdate").alias("period"), flag).agg(F.sum("l_quantity").alias("value"))
    o = o.withColumns({"origin": F.when(flag == "N", "dart").when(flag == "R", "ocr").otherwise("survey"), "ord": F.when(flag == "N", 1).when(flag == "R", 2).otherwise(3)}).where("NOT (origin = 'dart' AND corp % 2 = 0)")
    conf = F.when(F.col("ord") == 1, 1.0).when(F.col("ord") == 2, 0.8).otherwise(0.9)
    return o.select("corp", F.concat_ws(":", "origin", "corp", "period").alias("node_id"), F.lit("E-3-1").alias("metric"), "value", F.lit("tCO2eq").alias("unit"), "period", "origin", F.lit(None).cast("string").alias("source_file"), F.when(F.col("corp") % 4 == 0, "derived_from:x").otherwise("scan").alias("source"), conf.alias("confidence"), "ord")


@query(f"WITH {ORIGINS_SQL} SELECT a.node_id AS source_id, b.node_id AS target_id, round(CASE WHEN a.value = 0 THEN CASE WHEN b.value = 0 THEN 0 ELSE 100 END ELSE abs(b.value - a.value) / abs(a.value) * 100 END, 1) AS diff_pct FROM nodes a JOIN nodes b USING (corp, period) WHERE a.ord < b.ord")
def cross_check_graph(spark, d):
    """Edges between figures of one metric and period from different origins."""
    return evidence_graph.cross_checks(origins(spark, d), ["corp"]).select("source_id", "target_id", "diff_pct")


@query(f"""WITH {ORIGINS_SQL}, n AS (SELECT *, max(period) OVER (PARTITION BY corp) AS newest FROM nodes), p AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY origin <> 'dart', confidence DESC, ord) AS k, count(*) OVER (PARTITION BY corp) AS c, round(sum(value) OVER (PARTITION BY corp), 3) AS total FROM n WHERE period = newest)
    SELECT corp, period, CASE WHEN corp % 4 = 0 AND c > 1 THEN total ELSE value END AS value, round(confidence, 3)::DOUBLE AS confidence, CASE WHEN origin = 'dart' THEN 'verified' ELSE 'estimated' END AS verification, c AS n_links FROM p WHERE k = 1""")
def data_point_selection(spark, d):
    """The figure that stands for each company's emissions, and how many it is linked to."""
    p = evidence_graph.data_points(origins(spark, d), ["corp"])
    return p.select("corp", "period", "value", "confidence", "verification", F.size("links").cast("long").alias("n_links"))


@query(f"WITH {GRAPH_SQL} SELECT corp, period, round(value * CASE unit WHEN 'kWh' THEN 0.4781 / 1000 ELSE 0.0000561 END::DOUBLE, 3) AS value, 0.95::DOUBLE AS confidence, substr(sha1(corp || '||E-3-1||' || period || '||report||' || node_id), 1, 10) AS suffix FROM nodes")
def derived_emission_nodes(spark, d):
    """Emissions worked out from energy, by unit."""
    e = evidence_graph.derived_emissions(energy(spark, d)[0], ["corp"])
    return e.select("corp", "period", "value", "confidence", F.substring("node_id", 9, 10).alias("suffix"))
