"""What a company discloses of what is expected of it: coverage, selective disclosure, and answers to questionnaires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much leaving an item out weighs; ratios and the totals that give them context; what ISSB requires.
SENSITIVITY = {
    "E-3-1": 1.0, "E-3-2": 0.6, "E-6-1": 0.8, "E-7-1": 0.7, "E-7-2": 0.7, "E-8-1": 1.0, "E-2-1": 0.5, "E-4-1": 0.5, "E-5-1": 0.4,
    "S-4-2": 0.9, "S-2-3": 0.6, "S-8-2": 0.7, "S-9-1": 1.0, "G-4-1": 0.7, "G-6-1": 1.0,
}
CONTEXT = {"E-4-2": ["E-3-1", "E-4-1"], "E-6-2": ["E-6-1"], "E-5-2": ["E-5-1"], "E-2-2": ["E-2-1"]}
REQUIRED = ["E-3-1", "E-3-2"]
RATES, DISCREPANCY, ALERTS = ["E-5-2", "E-6-2"], 10.0, ["climate", "greenwash_defense"]


def item_status(expected: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, status, value, unit): expected items as mapped or missing, and reported ones beyond what is expected.

    expected and reported have the keys and code; reported also value and unit.
    """
    met = expected.select(*keys, "code", F.lit(True).alias("_in")).join(reported.select(*keys, "code", "value", "unit", F.lit(True).alias("_has")), [*keys, "code"], "full_outer")
    status = F.when(F.col("_in") & F.col("_has"), "mapped").when(F.col("_in"), "missing").otherwise("beyond")
    return met.select(*keys, "code", status.alias("status"), "value", "unit")


def coverage(status: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, present, expected, pct) by area (the code's first letter) and over all (area null)."""
    rows = status.where("status <> 'beyond'").withColumn("area", F.substring("code", 1, 1))
    counted = rows.cube(*keys, "area").agg(F.grouping_id().alias("_g"), F.count_if(F.col("status") == "mapped").alias("present"), F.count(F.lit(1)).alias("expected"))
    return counted.where("_g <= 1").select(*keys, "area", "present", "expected", F.round(100.0 * F.col("present") / F.col("expected"), 1).alias("pct"))


def selective_disclosure(status: DataFrame, keys: list[str], sensitivity: dict[str, float] = SENSITIVITY, context: dict[str, list[str]] = CONTEXT) -> DataFrame:
    """One row a company: score and level of selective disclosure, and what led to it.

    omitted lists the sensitive items left out, the heaviest first (a report names three of them).
    A: the weight of sensitive items left out, of those expected. B: ratios shown while a total that gives them context
    is missing, twice their share of all pairs. score = min(1, 0.45 A + 0.55 B).
    """
    rows = status.where("status <> 'beyond'").groupBy(*keys).agg(F.collect_set(F.when(F.col("status") == "mapped", F.col("code"))).alias("shown"), F.collect_set(F.when(F.col("status") == "missing", F.col("code"))).alias("left"))
    weights = F.array(*[F.struct((-F.lit(w)).alias("less"), F.lit(i).alias("i"), F.lit(c).alias("code")) for i, (c, w) in enumerate(sensitivity.items())])
    omitted = F.filter(weights, lambda x: F.array_contains("left", x["code"]))
    known = F.filter(weights, lambda x: F.array_contains("left", x["code"]) | F.array_contains("shown", x["code"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s - x["less"])
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), F.array(*map(F.lit, cs)).alias("needs")) for r, cs in context.items()])
    orphans = F.transform(F.filter(pairs, lambda p: F.array_contains("shown", p["ratio"]) & F.arrays_overlap(p["needs"], "left")), lambda p: F.struct(p["ratio"].alias("ratio"), F.array_intersect(p["needs"], "left").alias("missing")))
    a = F.coalesce(F.try_divide(total(omitted), total(known)), F.lit(0.0))
    b = F.least(F.lit(1.0), F.size("orphans") / float(max(len(context), 1)) * 2.0)
    rows = rows.withColumns({"omitted": omitted, "orphans": orphans, "_a": a}).withColumn("score", F.round(F.round(F.least(F.lit(1.0), 0.45 * F.col("_a") + 0.55 * b), 9), 4))
    level = F.when(F.col("score") < 0.25, "low").when(F.col("score") < 0.5, "medium").otherwise("high")
    shown_ratios = F.size(F.array_intersect("shown", F.array(*map(F.lit, context))))
    note = F.get(F.filter(F.array(*map(F.lit, REQUIRED)), lambda c: F.array_contains("left", c)), F.lit(0))
    return rows.select(*keys, "score", level.alias("level"), shown_ratios.alias("favourable"), F.size("omitted").alias("n_omitted"), F.transform(F.array_sort("omitted"), lambda x: x["code"]).alias("omitted"), "orphans", note.alias("required_omission"))


def alike_rate(unit: Column, code: Column) -> Column:
    u = F.coalesce(unit, F.lit(""))
    return u.contains("%") | u.contains("비율") | u.contains("이용률") | (F.lower(u) == "pct") | code.isin(RATES)


def numeric_answers(questions: DataFrame, status: DataFrame, points: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Answers to numeric questions (keys, qid, code): a data point's value by its verification, else the reported value,
    else open; then held against what the company claims.

    points: keys, code, value, unit, verification. claims: keys, code, claimed, claimed_unit. A claim without evidence
    is self-reported; a rate without a rate as evidence, a rate code out of 0 to 100, or ten points apart is flagged.
    """
    met = questions.join(points.select(*keys, "code", F.col("value").alias("_p"), F.col("unit").alias("_pu"), "verification"), [*keys, "code"], "left")
    met = met.join(status.where("status = 'mapped'").select(*keys, "code", F.col("value").alias("_m"), F.col("unit").alias("_mu")), [*keys, "code"], "left").join(claims, [*keys, "code"], "left")
    proven = F.when(F.col("verification") == "verified", "verified").when(F.col("verification") == "unverified", "flagged").otherwise("self_reported")
    first = F.when(F.col("_p").isNotNull(), proven).when(F.col("_m").isNotNull(), "self_reported").otherwise("insufficient")
    met = met.withColumns({"value": F.coalesce("_p", "_m"), "unit": F.when(F.col("_p").isNotNull(), F.col("_pu")).otherwise(F.col("_mu")), "_first": first})
    wants, rate = alike_rate(F.col("claimed_unit"), F.col("code")), alike_rate(F.col("unit"), F.lit(""))
    coded = F.col("code").isin(RATES)
    outside = coded & ~rate & ~F.col("value").between(0.0, 100.0)
    unlike = wants & ~rate & ~coded
    apart = F.round(F.abs(F.col("claimed") - F.col("value")), 1)
    says = F.col("claimed").isNotNull()
    final = F.when(~says, F.col("_first")).when(F.col("value").isNull(), "self_reported").when(outside | unlike | (apart >= DISCREPANCY), "flagged").otherwise(F.col("_first"))
    why = F.when(~says, F.lit(None)).when(F.col("value").isNull(), "unlinked").when(outside, "rate_out_of_range").when(unlike, "no_rate").when(apart >= DISCREPANCY, "discrepancy").otherwise("agrees")
    return met.select(*keys, "qid", "code", F.when(says & F.col("value").isNull(), F.col("claimed")).otherwise(F.col("value")).alias("value"), final.alias("status"), why.alias("claim"))


def gated(answers: DataFrame, disclosure: DataFrame, issb: DataFrame, keys: list[str]) -> DataFrame:
    """answers after the gates, of which the first that applies alone acts: an orphan ratio flags its answer, a sensitive
    omission notes an open one, a missing ISSB item of climate or greenwash defence flags, of others notes an open one.

    issb: keys, code, anchors of items that are expected and missing. gate names what applied.
    """
    met = answers.join(disclosure.select(*keys, "orphans", "omitted"), keys, "left").join(issb.select(*keys, "code", "anchors"), [*keys, "code"], "left")
    orphan = F.coalesce(F.exists("orphans", lambda o: o["ratio"] == F.col("code")), F.lit(False))
    open_ = F.col("status") == "insufficient"
    omission = F.coalesce(F.array_contains("omitted", F.col("code")), F.lit(False)) & open_
    alert = F.coalesce(F.arrays_overlap("anchors", F.array(*map(F.lit, ALERTS))), F.lit(False))
    gate = F.when(orphan, "orphan_ratio").when(omission, "sensitive_omission").when(alert, "issb_alert").when(F.col("anchors").isNotNull() & open_, "issb_note")
    return met.withColumn("gate", gate).withColumn("status", F.when(F.col("gate").isin("orphan_ratio", "issb_alert"), "flagged").otherwise(F.col("status"))).drop("orphans", "omitted", "anchors")


def issb_rows(mapping: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, standards, anchors, scope, status): each mapped code once, its standards and anchors in the order of
    the mapping (code, standard, anchor, ord), with what the company shows of it.
    """
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda s: s[c]))
    codes = mapping.groupBy("code").agg(ordered("standard").alias("standards"), ordered("anchor").alias("anchors"))
    met = status.join(codes, "code")
    scope = F.when(F.col("status") == "beyond", "beyond").otherwise("in_profile")
    return met.select(*keys, "code", "standards", "anchors", scope.alias("scope"), F.when(F.col("status") == "missing", "missing").otherwise("disclosed").alias("status"))


def issb_by_anchor(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anchor, n_items, n_missing): a row counts once under each of its anchors."""
    return rows.select(*keys, F.explode("anchors").alias("anchor"), "status").groupBy(*keys, "anchor").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("status") == "missing").alias("n_missing"))


def gaps(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, qid, code, status, action) of the answers that need work."""
    action = F.when(F.col("status") == "insufficient", "upload_evidence").when(F.col("status") == "flagged", "explain").when(F.col("status") == "self_reported", "link_evidence")
    return answers.withColumn("action", action).where("action IS NOT NULL").select(*keys, "qid", "code", "status", "action")
