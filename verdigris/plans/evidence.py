"""Claims against evidence, evidence series, and coverage of what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measures import ratio, relative_delta, risk_level, saturating
from ..operators import matching
from .registry import query, table

REVENUE = "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))"
EVIDENCE_SQL = f"SELECT o.*, e.evidence FROM orders o LEFT JOIN (SELECT l_orderkey, round({REVENUE}, 2) AS evidence FROM lineitem GROUP BY l_orderkey) e ON o.o_orderkey = e.l_orderkey"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders with what their lines add up to."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("evidence"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(f"""
    WITH c AS ({EVIDENCE_SQL}), s AS (SELECT o_orderpriority, least(1.0, abs(o_totalprice - evidence) / evidence / 0.15) AS score FROM c WHERE evidence > 0)
    SELECT o_orderpriority, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'medium' ELSE 'high' END AS level, count(*) AS n_claims, round(avg(score), 6) AS mean_score
    FROM s GROUP BY ALL""")
def order_delta_levels(spark, d):
    score = saturating(relative_delta(F.col("o_totalprice"), F.col("evidence")), 0.15)
    rows = claims(spark, d).where("evidence > 0").select("o_orderpriority", score.alias("score"))
    return rows.groupBy("o_orderpriority", risk_level(F.col("score")).alias("level")).agg(F.count(F.lit(1)).alias("n_claims"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH c AS ({EVIDENCE_SQL}) SELECT o_orderkey, o_totalprice, evidence, round(abs(o_totalprice - evidence) / evidence * 100, 6) AS diff_pct FROM c WHERE evidence > 0 AND abs(o_totalprice - evidence) / evidence * 100 <= 2")
def order_delta_within_2pct(spark, d):
    diff = relative_delta(F.col("o_totalprice"), F.col("evidence")) * 100
    return claims(spark, d).where("evidence > 0").where(diff <= 2).select("o_orderkey", "o_totalprice", "evidence", F.round(diff, 6).alias("diff_pct"))


@query(f"WITH c AS ({EVIDENCE_SQL}) SELECT o_orderstatus, CASE WHEN evidence IS NULL THEN 'unverifiable' WHEN abs(o_totalprice - evidence) / evidence <= 0.1 THEN 'match' ELSE 'mismatch' END AS verdict, count(*) AS n FROM c GROUP BY ALL")
def claim_verdict_10pct(spark, d):
    delta = relative_delta(F.col("o_totalprice"), F.col("evidence"))
    verdict = F.when(F.col("evidence").isNull(), "unverifiable").when(delta <= 0.1, "match").otherwise("mismatch")
    return claims(spark, d).groupBy("o_orderstatus", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH c AS ({EVIDENCE_SQL}) SELECT o_orderkey, CASE WHEN evidence IS NULL THEN 'unverified' WHEN abs(o_totalprice - evidence) / evidence * 100 >= 10 THEN 'flagged' WHEN abs(o_totalprice - evidence) / evidence * 100 >= 2 THEN 'review' ELSE 'reconciled' END AS status FROM c")
def reconcile_claims_10pp(spark, d):
    diff = relative_delta(F.col("o_totalprice"), F.col("evidence")) * 100
    status = F.when(F.col("evidence").isNull(), "unverified").when(diff >= 10, "flagged").when(diff >= 2, "review").otherwise("reconciled")
    return claims(spark, d).select("o_orderkey", status.alias("status"))


def _origin_sql(flag: str) -> str:
    return f"SELECT l_partkey AS metric, CAST(year(l_shipdate) AS INT) AS period, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY ALL"


def origin(spark, d, flag):
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("metric"), F.year("l_shipdate").alias("period")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))


@query(f"SELECT metric, period, x.v AS a, y.v AS b, round(CASE WHEN y.v = 0 AND x.v = 0 THEN 0 WHEN y.v = 0 THEN 100 ELSE abs(x.v - y.v) / abs(y.v) * 100 END, 6) AS diff_pct FROM ({_origin_sql('R')}) x JOIN ({_origin_sql('N')}) y USING (metric, period)")
def cross_check_edges(spark, d):
    return matching.cross_check(origin(spark, d, "R"), origin(spark, d, "N"), ["metric", "period"], "v").withColumn("diff_pct", F.round("diff_pct", 6))


NATION_YEAR_SQL = "SELECT n_name, CAST(year(o_orderdate) AS INT) AS period, round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


def nation_years(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH s AS ({NATION_YEAR_SQL}), e AS (SELECT *, lag(v) OVER w AS previous, first(v) OVER w AS f, first(period) OVER w AS fp FROM s WINDOW w AS (PARTITION BY n_name ORDER BY period))
    SELECT n_name, period, v, round((v - previous) / abs(previous) * 100, 3) AS yoy, CASE WHEN f > 0 AND period > fp THEN round((pow(v / f, 1.0 / (period - fp)) - 1) * 100, 3) END AS cagr FROM e""")
def yoy_cagr_by_nation(spark, d):
    return matching.series_edges(nation_years(spark, d), ["n_name"], "period", "v").select("n_name", "period", "v", "yoy", "cagr")


@query(f"""
    WITH s AS ({NATION_YEAR_SQL}), e AS (SELECT n_name, sign(v - lag(v) OVER w) AS dv, sign(n - lag(n) OVER w) AS dn FROM s WINDOW w AS (PARTITION BY n_name ORDER BY period))
    SELECT n_name, count(dv) AS n_edges, count(*) FILTER (dv * dn < 0) AS n_contradictions, round(least(1.0, coalesce(count(*) FILTER (dv * dn < 0)::DOUBLE / nullif(count(dv), 0), 0) / 0.2), 6) AS score FROM e GROUP BY n_name""")
def timeseries_contradiction(spark, d):
    w = Window.partitionBy("n_name").orderBy("period")
    e = nation_years(spark, d).select("n_name", F.sign(F.col("v") - F.lag("v").over(w)).alias("dv"), F.sign(F.col("n") - F.lag("n").over(w)).alias("dn"))
    counted = e.groupBy("n_name").agg(F.count("dv").alias("n_edges"), F.count_if(F.col("dv") * F.col("dn") < 0).alias("n_contradictions"))
    return counted.withColumn("score", F.round(F.least(F.lit(1.0), ratio(F.col("n_contradictions"), F.col("n_edges")) / 0.2), 6))


@query("""
    WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    u AS (SELECT l_returnflag, l_linestatus, 'energy' AS metric, 'kWh' AS unit, q AS v FROM s UNION ALL SELECT l_returnflag, l_linestatus, 'emission', 'tCO2eq', round(q * 0.4781 / 1000, 3) FROM s)
    SELECT substr(sha1(l_returnflag || '||' || l_linestatus || '||' || metric), 1, 10) AS node_id, metric, unit, v FROM u""")
def derived_metric_union(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    nodes = s.select("l_returnflag", "l_linestatus", F.lit("energy").alias("metric"), F.lit("kWh").alias("unit"), F.col("q").alias("v"))
    nodes = nodes.unionByName(s.select("l_returnflag", "l_linestatus", F.lit("emission").alias("metric"), F.lit("tCO2eq").alias("unit"), F.round(F.col("q") * 0.4781 / 1000, 3).alias("v")))
    return nodes.select(F.substring(F.sha1(F.concat_ws("||", "l_returnflag", "l_linestatus", "metric").cast("binary")), 1, 10).alias("node_id"), "metric", "unit", "v")


@query("""
    WITH r AS (SELECT *, year(l_shipdate) AS period, max(year(l_shipdate)) OVER (PARTITION BY l_partkey) AS latest FROM lineitem),
    p AS (SELECT l_partkey, period, l_quantity, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_partkey) AS total,
          row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'N') DESC, l_quantity DESC, l_orderkey, l_linenumber) AS rn FROM r WHERE period = latest)
    SELECT l_partkey, CAST(period AS INT) AS period, l_quantity AS confirmed, l_orderkey AS source_order, total FROM p WHERE rn = 1""")
def latest_line_of_part(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("period"), "l_quantity", "l_orderkey", "l_linenumber", "l_returnflag")
    newest = rows.groupBy("l_partkey").agg(F.max("period").alias("period"))
    at = rows.join(newest, ["l_partkey", "period"])
    first = F.min(F.struct((F.col("l_returnflag") != "N").alias("late"), (-F.col("l_quantity")).alias("less"), "l_orderkey", "l_linenumber")).alias("best")
    best = at.groupBy("l_partkey", "period").agg(first, F.sum("l_quantity").alias("total"))
    return best.select("l_partkey", "period", (-F.col("best.less")).alias("confirmed"), F.col("best.l_orderkey").alias("source_order"), "total")


PAIRS_SQL = "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem"


def supplied(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query(f"""
    WITH e AS (SELECT p_type, count(*) * (SELECT count(*) FROM supplier) AS expected FROM part GROUP BY p_type),
    f AS (SELECT p_type, count(*) AS present FROM ({PAIRS_SQL}) JOIN part ON l_partkey = p_partkey GROUP BY p_type),
    j AS (SELECT p_type, expected, coalesce(present, 0) AS present FROM e LEFT JOIN f USING (p_type))
    SELECT p_type, CAST(sum(present) AS BIGINT) AS present, CAST(sum(expected) AS BIGINT) AS expected, round(100.0 * sum(present) / sum(expected), 3) AS coverage_pct FROM j GROUP BY ROLLUP (p_type)""")
def coverage_rollup(spark, d):
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    expected = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("parts")).crossJoin(F.broadcast(n)).select("p_type", (F.col("parts") * F.col("n")).alias("e"))
    found = supplied(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count(F.lit(1)).alias("p"))
    joined = expected.join(found, "p_type", "left").rollup("p_type").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("present"), F.sum("e").alias("expected"))
    return joined.withColumn("coverage_pct", F.round(100.0 * F.col("present") / F.col("expected"), 3))


# Weights of the kinds of item, by the first word of their type.
WEIGHTS = {"ECONOMY": 0.6, "STANDARD": 1.0, "PROMO": 0.8}
WEIGHT_SQL = "CASE split_part(p_type, ' ', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0.5 END"
DISCLOSURE_SQL = f"""
    SELECT l_suppkey, n_disclosed, round(least(1.0, 0.45 * (total - have) / total + 0.55 * least(1.0, 2.0 * orphans / n_disclosed)), 6) AS score
    FROM (SELECT l_suppkey, count(*) AS n_disclosed, round(sum({WEIGHT_SQL}), 2) AS have, count(*) FILTER (p_size > 40) AS orphans FROM ({PAIRS_SQL}) JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey),
         (SELECT round(sum({WEIGHT_SQL}), 2) AS total FROM part)"""


def disclosure(spark, d):
    """Per supplier the weighted share of items it leaves out, and how often it shows large ones without context."""
    weight = F.coalesce(*[F.when(F.split("p_type", " ")[0] == k, v) for k, v in WEIGHTS.items()], F.lit(0.5))
    part = table(spark, d, "part").select("p_partkey", "p_size", weight.alias("w"))
    total = part.agg(F.round(F.sum("w"), 2).alias("total"))
    have = supplied(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_disclosed"), F.round(F.sum("w"), 2).alias("have"), F.count_if(F.col("p_size") > 40).alias("orphans"))
    score = F.least(F.lit(1.0), 0.45 * (F.col("total") - F.col("have")) / F.col("total") + 0.55 * F.least(F.lit(1.0), 2.0 * F.col("orphans") / F.col("n_disclosed")))
    return have.crossJoin(F.broadcast(total)).select("l_suppkey", "n_disclosed", F.round(score, 6).alias("score"))


@query(DISCLOSURE_SQL)
def selective_disclosure_score(spark, d):
    return disclosure(spark, d)


@query(f"""
    WITH s AS (SELECT CASE WHEN score < 0.5 THEN 'low' WHEN score < 0.7 THEN 'medium' ELSE 'high' END AS predicted, CASE WHEN s_acctbal < 2000 THEN 'high' WHEN s_acctbal < 6000 THEN 'medium' ELSE 'low' END AS expected FROM ({DISCLOSURE_SQL}) JOIN supplier ON l_suppkey = s_suppkey)
    SELECT expected, count(*) FILTER (predicted = 'low') AS low, count(*) FILTER (predicted = 'medium') AS medium, count(*) FILTER (predicted = 'high') AS high FROM s GROUP BY expected""")
def disclosure_confusion(spark, d):
    rows = disclosure(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    expected = F.when(F.col("s_acctbal") < 2000, "high").when(F.col("s_acctbal") < 6000, "medium").otherwise("low")
    rows = rows.select(risk_level(F.col("score"), 0.5, 0.7).alias("predicted"), expected.alias("expected"))
    return rows.groupBy("expected").pivot("predicted", ["low", "medium", "high"]).count().na.fill(0)


ANCHORS = {"ECONOMY": ["climate", "cost"], "STANDARD": ["governance"], "PROMO": ["claims", "cost"]}
ANCHOR_SQL = "CASE split_part(p_type, ' ', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ANCHORS.items()) + " ELSE ['other'] END"


@query(f"""
    WITH n AS (SELECT p_partkey, p_type, count(l_suppkey) AS have FROM part LEFT JOIN ({PAIRS_SQL}) ON l_partkey = p_partkey GROUP BY ALL),
    x AS (SELECT unnest({ANCHOR_SQL}) AS anchor, have FROM n)
    SELECT anchor, count(*) AS n_items, count(*) FILTER (have = 0) AS n_missing, CAST(sum(have) AS BIGINT) AS n_evidence FROM x GROUP BY anchor""")
def gap_by_anchor(spark, d):
    kind = F.split("p_type", " ")[0]
    anchors = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in ANCHORS.items()], F.array(F.lit("other")))
    have = supplied(spark, d).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("have"))
    rows = table(spark, d, "part").join(have, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.explode(anchors).alias("anchor"), F.coalesce("have", F.lit(0)).alias("have"))
    return rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("have") == 0).alias("n_missing"), F.sum("have").alias("n_evidence"))


@query("""SELECT code, count(*) AS n_items, min(p_partkey) AS first_item FROM (SELECT p_partkey, unnest(list_distinct([p_brand, 'T-' || split_part(p_type, ' ', 1), 'S-' || CAST(p_size // 10 AS VARCHAR), p_brand])) AS code FROM part) GROUP BY code""")
def crosswalk_expand(spark, d):
    codes = F.array_distinct(F.array("p_brand", F.concat(F.lit("T-"), F.split("p_type", " ")[0]), F.concat(F.lit("S-"), F.floor(F.col("p_size") / 10).cast("string")), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_items"), F.min("p_partkey").alias("first_item"))


@query(f"""
    WITH a AS (SELECT s_suppkey, s_nationkey, coalesce(n_disclosed, 0) AS n, score FROM supplier LEFT JOIN ({DISCLOSURE_SQL}) ON s_suppkey = l_suppkey)
    SELECT s_nationkey, count(*) FILTER (n > 0 AND score < 0.6) AS answered, count(*) FILTER (n > 0 AND score >= 0.6) AS partial, count(*) FILTER (n = 0) AS missing, round(100.0 * count(*) FILTER (n > 0 AND score < 0.6) / count(*), 3) AS answered_pct FROM a GROUP BY s_nationkey""")
def questionnaire_status(spark, d):
    rows = table(spark, d, "supplier").join(disclosure(spark, d), F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("n", F.coalesce("n_disclosed", F.lit(0)))
    done, part = (F.col("n") > 0) & (F.col("score") < 0.6), (F.col("n") > 0) & (F.col("score") >= 0.6)
    counted = rows.groupBy("s_nationkey").agg(F.count_if(done).alias("answered"), F.count_if(part).alias("partial"), F.count_if(F.col("n") == 0).alias("missing"), F.count(F.lit(1)).alias("_all"))
    return counted.withColumn("answered_pct", F.round(100.0 * F.col("answered") / F.col("_all"), 3)).drop("_all")


@query(f"WITH c AS ({EVIDENCE_SQL}) SELECT o_orderpriority, count(*) AS n_bills, count(*) FILTER (evidence IS NULL) AS skipped, count(*) FILTER (abs(o_totalprice - evidence) <= greatest(1.0, 0.02 * evidence)) AS consistent, count(*) FILTER (abs(o_totalprice - evidence) > greatest(1.0, 0.02 * evidence)) AS inconsistent FROM c GROUP BY 1")
def bill_consistency(spark, d):
    gap, slack = F.abs(F.col("o_totalprice") - F.col("evidence")), F.greatest(F.lit(1.0), 0.02 * F.col("evidence"))
    return claims(spark, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_bills"), F.count_if(F.col("evidence").isNull()).alias("skipped"), F.count_if(gap <= slack).alias("consistent"), F.count_if(gap > slack).alias("inconsistent"))


@query("""
    WITH c AS (SELECT c_name AS name, c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_suppkey, 'supplier' FROM supplier)
    SELECT name, id, kind FROM c WHERE contains(lower(name), '00001') ORDER BY (lower(name) = '00001') DESC, starts_with(lower(name), '00001') DESC, (kind = 'supplier') DESC, name LIMIT 20""")
def company_search_ranked(spark, d):
    q = "00001"
    both = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))
    low = F.lower("name")
    return both.where(low.contains(q)).orderBy(F.desc(low == q), F.desc(low.startswith(q)), F.desc(F.col("kind") == "supplier"), "name").limit(20)


TABLE_SQL = "SELECT l_orderkey, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total, round(sum(CASE WHEN l_linenumber < m THEN l_extendedprice END), 2) AS above, round(max(CASE WHEN l_linenumber = m THEN l_extendedprice END), 2) AS last_row, median(l_extendedprice) AS mid, max(l_extendedprice) AS top, min(l_extendedprice) AS low FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY l_orderkey"


def order_tables(spark, d):
    """Each order's lines as a small table: its rows, totals and spread."""
    lines = table(spark, d, "lineitem")
    m = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    price = F.col("l_extendedprice")
    return lines.join(m, "l_orderkey").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(price), 2).alias("total"), F.round(F.sum(F.when(F.col("l_linenumber") < F.col("m"), price)), 2).alias("above"),
        F.round(F.max(F.when(F.col("l_linenumber") == F.col("m"), price)), 2).alias("last_row"), F.median(price).alias("mid"), F.max(price).alias("top"), F.min(price).alias("low"),
    )


@query(f"WITH t AS ({TABLE_SQL}) SELECT n_rows, count(*) AS n_tables, count(*) FILTER (abs(last_row - above) <= 0.05 * abs(above)) AS total_row_ok, round(avg(total), 2) AS mean_total FROM t WHERE n_rows > 1 GROUP BY n_rows")
def order_totals_check(spark, d):
    ok = F.abs(F.col("last_row") - F.col("above")) <= 0.05 * F.abs(F.col("above"))
    return order_tables(spark, d).where("n_rows > 1").groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_tables"), F.count_if(ok).alias("total_row_ok"), F.round(F.avg("total"), 2).alias("mean_total"))


@query(f"WITH t AS ({TABLE_SQL}) SELECT l_orderkey, mid, top, top > 3 * mid AS out_of_scale FROM t WHERE n_rows >= 3")
def order_magnitude_check(spark, d):
    return order_tables(spark, d).where("n_rows >= 3").select("l_orderkey", "mid", "top", (F.col("top") > 3 * F.col("mid")).alias("out_of_scale"))


@query(f"""WITH t AS ({TABLE_SQL}), f AS (SELECT *, (n_rows < 2)::INT AS few, (top > 3 * mid)::INT AS scale, (low < 0.05 * mid)::INT AS tiny FROM t)
    SELECT CASE WHEN few = 1 THEN 'HUMAN' WHEN scale + tiny >= 2 THEN 'HUMAN' WHEN scale + tiny = 1 THEN 'ESCALATE' ELSE 'ACCEPT' END AS decision, count(*) AS n, CAST(sum(few) AS BIGINT) AS n_few, CAST(sum(scale) AS BIGINT) AS n_scale, CAST(sum(tiny) AS BIGINT) AS n_tiny FROM f GROUP BY 1""")
def order_table_decision(spark, d):
    flags = {"few": F.col("n_rows") < 2, "scale": F.col("top") > 3 * F.col("mid"), "tiny": F.col("low") < 0.05 * F.col("mid")}
    rows = order_tables(spark, d).withColumns({k: v.cast("int") for k, v in flags.items()})
    soft = F.col("scale") + F.col("tiny")
    decision = F.when(F.col("few") == 1, "HUMAN").when(soft >= 2, "HUMAN").when(soft == 1, "ESCALATE").otherwise("ACCEPT")
    return rows.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(f"n_{k}") for k in flags])


@query("""SELECT l_orderkey, l_linenumber, coalesce(h, last_value(h IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)) AS header
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity >= 25 THEN l_returnflag || l_linestatus END AS h FROM lineitem)""")
def header_fill(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_quantity") >= 25, F.concat("l_returnflag", "l_linestatus")).alias("h"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("h", F.last("h", ignorenulls=True).over(w)).alias("header"))
