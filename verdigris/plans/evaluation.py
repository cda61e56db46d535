"""Evaluation of a simple rule score against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from .registry import query, table

# Share of symbols and of line breaks, in hundredths, as a stand-in for a detector's risk.
SCORED_SQL = "SELECT doc_id, lang, quality = 0 AS positive, round(least(1.0, 20.0 * len(regexp_extract_all(text, '[#*$%&|<>]')) / greatest(1, n_chars)), 2) AS p FROM documents JOIN labels USING (doc_id)"


def scored(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit("[#*$%&|<>]"), F.lit(0)))
    p = F.round(F.least(F.lit(1.0), 20.0 * n / F.greatest(F.lit(1), F.col("n_chars"))), 2)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", (F.col("quality") == 0).alias("positive"), p.alias("p"))


PRF_SQL = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@query(f"WITH s AS ({SCORED_SQL}), c AS (SELECT lang, count(*) FILTER (p >= 0.1 AND positive) AS tp, count(*) FILTER (p >= 0.1 AND NOT positive) AS fp, count(*) FILTER (p < 0.1 AND positive) AS fn, count(*) FILTER (p < 0.1 AND NOT positive) AS tn FROM s GROUP BY lang) SELECT *, {PRF_SQL} FROM c")
def confusion_prf(spark, d):
    return scoring.confusion(scored(spark, d), ["lang"], F.col("p") >= 0.1, F.col("positive"))


@query(f"""WITH s AS ({SCORED_SQL}), b AS (SELECT p, count(*) FILTER (positive) AS a, count(*) FILTER (NOT positive) AS n FROM s GROUP BY p),
    c AS (SELECT p AS threshold, CAST(sum(a) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS fp, (SELECT count(*) FROM s WHERE positive) - CAST(sum(a) OVER (ORDER BY p DESC) AS BIGINT) AS fn FROM b) SELECT *, {PRF_SQL} FROM c""")
def threshold_sweep(spark, d):
    return scoring.sweep(scored(spark, d), "p", "positive")


@query(f"""WITH s AS ({SCORED_SQL}), g AS (SELECT t / 20.0 AS threshold, k / 10.0 AS gain FROM range(1, 16) r(t), range(5, 16) q(k)),
    c AS (SELECT threshold, gain, count(*) FILTER (p * gain >= threshold AND positive) AS tp, count(*) FILTER (p * gain >= threshold AND NOT positive) AS fp, count(*) FILTER (p * gain < threshold AND positive) AS fn FROM (SELECT p, positive FROM s), g GROUP BY ALL)
    SELECT threshold::DOUBLE AS threshold, gain::DOUBLE AS gain, tp, fp, fn, {PRF_SQL} FROM c""")
def grid_search_f1(spark, d):
    """165 configurations; rows are counted by score (at most 101 of them) before they meet the grid."""
    by = scored(spark, d).groupBy("p").agg(F.count_if(F.col("positive")).alias("a"), F.count_if(~F.col("positive")).alias("n"))
    grid = F.array(*[F.struct(F.lit(t / 20).alias("threshold"), F.lit(k / 10).alias("gain")) for t in range(1, 16) for k in range(5, 16)])
    rows = by.select("p", "a", "n", F.explode(grid).alias("g")).withColumn("flag", F.col("p") * F.col("g.gain") >= F.col("g.threshold"))
    c = rows.groupBy(F.col("g.threshold").alias("threshold"), F.col("g.gain").alias("gain")).agg(*[F.coalesce(F.sum(F.when(f, F.col(x))), F.lit(0)).alias(name) for name, f, x in (("tp", F.col("flag"), "a"), ("fp", F.col("flag"), "n"), ("fn", ~F.col("flag"), "a"))])
    return c.withColumns(scoring.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""WITH s AS ({SCORED_SQL}), f AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS conf, avg(((p >= 0.5) = positive)::INT) AS acc FROM s GROUP BY 1)
    SELECT CAST(r.b AS INT) AS bin, coalesce(n, 0) AS n, round(conf, 6) AS conf, round(acc, 6) AS acc, round(coalesce(n::DOUBLE / (SELECT count(*) FROM s) * abs(conf - acc), 0), 6) AS gap FROM range(10) r(b) LEFT JOIN f ON f.bin = r.b""")
def calibration_ece(spark, d):
    return scoring.calibration(scored(spark, d).withColumn("correct", (F.col("p") >= 0.5) == F.col("positive")), "p", "correct")


@query(f"""WITH s AS ({SCORED_SQL}), b AS (SELECT round(abs(p - 0.5), 2) AS conf, count(*) AS n, count(*) FILTER ((p >= 0.5) = positive) AS good FROM s GROUP BY 1)
    SELECT conf, CAST(sum(n) OVER w AS BIGINT) AS covered, round(sum(good) OVER w / sum(n) OVER w, 6) AS accuracy FROM b WINDOW w AS (ORDER BY conf DESC)""")
def risk_coverage(spark, d):
    b = scored(spark, d).groupBy(F.round(F.abs(F.col("p") - 0.5), 2).alias("conf")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") >= 0.5) == F.col("positive")).alias("good"))
    return scoring.running(b, "conf", True, ["n", "good"]).select("conf", F.col("n").alias("covered"), F.round(F.col("good") / F.col("n"), 6).alias("accuracy"))


RESAMPLES = 2000
STEPS_SQL = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253))


@query(f"""WITH s AS ({SCORED_SQL}), d AS (SELECT positive, p >= 0.1 AS flagged, b, ('0x' || substr(md5(doc_id || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, range({RESAMPLES}) r(b) WHERE positive OR p >= 0.1),
    f AS (SELECT b, round(coalesce(2.0 * sum(CASE WHEN positive AND flagged THEN n ELSE 0 END) / nullif(sum(CASE WHEN positive AND flagged THEN n ELSE 0 END) + sum(n), 0), 0), 6) AS f1 FROM (SELECT *, {STEPS_SQL} AS n FROM d) GROUP BY b),
    x AS (SELECT list_sort(list(f1)) AS x FROM f), c AS (SELECT count(*) FILTER (positive AND p >= 0.1) AS tp, count(*) FILTER (NOT positive AND p >= 0.1) AS fp, count(*) FILTER (positive AND p < 0.1) AS fn FROM s)
    SELECT round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6)::DOUBLE AS f1, x[{int(0.025 * RESAMPLES) + 1}]::DOUBLE AS low, x[{int(0.975 * RESAMPLES) + 1}]::DOUBLE AS high FROM x, c""")
def bootstrap_ci(spark, d):
    """F1 of the rule and its interval from 2,000 resamples."""
    s, positive, flagged = scored(spark, d), F.col("positive"), F.col("p") >= 0.1
    point = scoring.confusion(s.withColumn("one", F.lit(1)), ["one"], flagged, positive).select("f1")
    return point.crossJoin(F.broadcast(scoring.interval(scoring.bootstrap(s, "doc_id", positive, flagged, RESAMPLES), "f1", RESAMPLES)))


@query(f"""WITH s AS ({SCORED_SQL}), b AS (SELECT p, count(*) FILTER (positive) AS a, count(*) FILTER (NOT positive) AS n FROM s GROUP BY p),
    c AS (SELECT p AS threshold, CAST(sum(a) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS fp, (SELECT count(*) FROM s WHERE positive) - CAST(sum(a) OVER (ORDER BY p DESC) AS BIGINT) AS fn FROM b), m AS (SELECT *, {PRF_SQL} FROM c)
    SELECT * FROM m ORDER BY f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, d):
    return scoring.best_threshold(scoring.sweep(scored(spark, d), "p", "positive"))


# The configurations tried.
GRID = [(t, w, h, a) for t in (0.15, 0.20, 0.25, 0.30, 0.35, 0.40) for w in (0.2, 0.3, 0.4, 0.5, 0.6) for h in (0.15, 0.20, 0.25, 0.30, 0.35) for a in (0.70, 0.80, 0.90)]
VERDICTS = {"d1": 3, "d2": 4, "d5": 5}


@query(f"""WITH s AS ({SCORED_SQL}), k AS (SELECT positive, p AS d1, round((doc_id % 37) / 37.0, 2)::DOUBLE AS d2, round((doc_id % 11) / 10.0, 2)::DOUBLE AS d5, 0.5::DOUBLE AS d3, round((doc_id % 7) / 10.0, 2)::DOUBLE AS llm, doc_id FROM s),
    g AS (SELECT t::DOUBLE AS trigger, w::DOUBLE AS rule_weight, h::DOUBLE AS threshold, a::DOUBLE AS axis_flag FROM (SELECT unnest([0.15, 0.20, 0.25, 0.30, 0.35, 0.40]) AS t), (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6]) AS w), (SELECT unnest([0.15, 0.20, 0.25, 0.30, 0.35]) AS h), (SELECT unnest([0.70, 0.80, 0.90]) AS a)),
    x AS (SELECT g.*, positive, d3, {', '.join(f"CASE WHEN doc_id % {m} < 2 AND {n} >= trigger THEN CASE WHEN doc_id % {m} = 0 THEN llm ELSE round(rule_weight * {n} + (1 - rule_weight) * llm, 4) END ELSE {n} END AS {n}" for n, m in VERDICTS.items())} FROM k, g),
    f AS (SELECT *, round(0.4::DOUBLE * d1 + 0.25::DOUBLE * d2 + 0.25::DOUBLE * d3 + 0.1::DOUBLE * d5, 4) >= threshold OR greatest(d1, d2, d5) >= axis_flag AS flagged FROM x),
    c AS (SELECT trigger, rule_weight, threshold, axis_flag, count(*) FILTER (flagged AND positive) AS tp, count(*) FILTER (flagged AND NOT positive) AS fp, count(*) FILTER (NOT flagged AND positive) AS fn, count(*) FILTER (NOT flagged AND NOT positive) AS tn FROM f GROUP BY ALL)
    SELECT *, {PRF_SQL} FROM c""")
def judge_grid_search(spark, d):
    """450 configurations of trigger, blend, threshold and axis flag."""
    i = F.col("doc_id")
    cases = scored(spark, d).select("positive", F.col("p").alias("d1"), F.round(i % 37 / 37.0, 2).alias("d2"), F.round(i % 11 / 10.0, 2).alias("d5"), F.lit(0.5).alias("d3"), F.round(i % 7 / 10.0, 2).alias("llm"), "doc_id")
    for name, m in VERDICTS.items():
        cases = cases.withColumns({f"{name}_verdict": F.when(i % m == 0, "false_positive").when(i % m == 1, "confirmed"), f"{name}_llm": F.col("llm")})
    return scoring.grid_search(cases, GRID)


@query(f"""WITH s AS ({SCORED_SQL}), r AS (SELECT (p >= 0.5) = positive AS good, row_number() OVER (ORDER BY round(abs(p - 0.5), 2) DESC, doc_id) AS k, count(*) OVER () AS n FROM s),
    c AS (SELECT coverage::DOUBLE AS coverage, greatest(1, round_even(n * coverage, 0)::BIGINT) AS auto_n, n, good, k FROM r, (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5]) AS coverage))
    SELECT coverage, auto_n, n - auto_n AS defer_n, round(count(*) FILTER (k <= auto_n AND good)::DOUBLE / auto_n, 3) AS accuracy FROM c GROUP BY coverage, auto_n, n""")
def abstention_curve(spark, d):
    """Accuracy if the surest 100 to 50 per cent are decided alone."""
    rows = scored(spark, d).select("doc_id", F.round(F.abs(F.col("p") - 0.5), 2).alias("conf"), ((F.col("p") >= 0.5) == F.col("positive")).alias("good"))
    return scoring.risk_coverage(rows, "doc_id", "conf", "good")


@query(f"""WITH s AS ({SCORED_SQL}) SELECT lang, count(*) AS n, count(*) FILTER (positive) AS n_pos, count(*) = count(DISTINCT doc_id) AS unique_ids, min(p) >= 0 AND max(p) <= 1 AS in_range FROM s GROUP BY lang HAVING count(*) >= 1""")
def gold_constraints(spark, d):
    return scored(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("positive")).alias("n_pos"), (F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("unique_ids"), ((F.min("p") >= 0) & (F.max("p") <= 1)).alias("in_range")).where("n >= 1")
