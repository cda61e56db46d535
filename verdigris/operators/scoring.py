"""Confusion metrics, sweeps and calibration as plans over rows (score, positive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ratio


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)}


def confusion(rows: DataFrame, keys: list[str], flagged: Column, positive: Column) -> DataFrame:
    counts = rows.groupBy(*keys).agg(
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"), F.count_if(~flagged & positive).alias("fn"), F.count_if(~flagged & ~positive).alias("tn")
    )
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def running(rows: DataFrame, by: str, descending: bool, sums: list[str], bins: int = 1024) -> DataFrame:
    """rows, one a distinct value of `by`, with each sum over all rows up to it.

    Rows are cut into ranges of `by`; only a row a range is ordered in one task, so that distinct values may be many.
    """
    order = F.desc(by) if descending else F.asc(by)
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return rows
    width = (float(high) - float(low)) / bins or 1.0
    cut = F.least(F.lit(bins - 1), F.floor((F.col(by) - F.lit(float(low))) / width))
    rows = rows.withColumn("_cut", cut)
    before = Window.orderBy(F.desc("_cut") if descending else F.asc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_cut").agg(*[F.sum(s).alias(s) for s in sums])
    totals = totals.select("_cut", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in sums])
    within = Window.partitionBy("_cut").orderBy(order)
    return rows.join(F.broadcast(totals), "_cut").withColumns({s: F.sum(s).over(within) + F.col(f"_{s}") for s in sums}).drop("_cut", *[f"_{s}" for s in sums])


def sweep(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Counts and metrics with each distinct score as the cut-off; scores are summed before any ordering."""
    by_score = rows.groupBy(score).agg(F.count_if(F.col(positive)).alias("tp"), F.count_if(~F.col(positive)).alias("fp"))
    total = rows.agg(F.count_if(F.col(positive)).alias("all_p"))
    cum = running(by_score, score, True, ["tp", "fp"]).select(F.col(score).alias("threshold"), "tp", "fp").crossJoin(F.broadcast(total))
    return cum.withColumn("fn", F.col("all_p") - F.col("tp")).withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).drop("all_p")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the best F1, the lowest cut-off of equals."""
    return swept.agg(F.max_by(F.struct(*swept.columns), F.struct("f1", -F.col("threshold"))).alias("x")).select("x.*")


def grid_search(cases: DataFrame, grid: list[tuple[float, float, float, float]]) -> DataFrame:
    """Counts and metrics of every configuration (trigger, rule_weight, threshold, axis_flag) over all cases.

    cases: positive, and for each axis d1, d2, d5 its rule score, verdict (null: not judged) and llm score; d3 is a rule
    score alone. A judged axis at or over the trigger takes the judge's score if it was a false positive, else a blend.
    A case is flagged by its weighted risk or by its largest axis. Cases aren't shuffled: only counts are.
    """
    config = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("trigger", "rule_weight", "threshold", "axis_flag"), g)]) for g in grid])
    rows = cases.select("*", F.explode(config).alias("g"))

    def axis(name: str) -> Column:
        rule, verdict, llm = F.col(name), F.col(f"{name}_verdict"), F.col(f"{name}_llm")
        blend = F.round(F.col("g.rule_weight") * rule + (1 - F.col("g.rule_weight")) * llm, 4)
        return F.when(verdict.isNotNull() & (rule >= F.col("g.trigger")), F.when(verdict == "false_positive", F.round(llm, 4)).otherwise(blend)).otherwise(rule)

    rows = rows.withColumns({f"_{n}": axis(n) for n in ("d1", "d2", "d5")})
    risk = F.round(0.40 * F.col("_d1") + 0.25 * F.col("_d2") + 0.25 * F.col("d3") + 0.10 * F.col("_d5"), 4)
    flagged = (risk >= F.col("g.threshold")) | (F.greatest("_d1", "_d2", "_d5") >= F.col("g.axis_flag"))
    keys = [F.col(f"g.{n}").alias(n) for n in ("trigger", "rule_weight", "threshold", "axis_flag")]
    c = rows.groupBy(*keys).agg(F.count_if(flagged & F.col("positive")).alias("tp"), F.count_if(flagged & ~F.col("positive")).alias("fp"), F.count_if(~flagged & F.col("positive")).alias("fn"), F.count_if(~flagged & ~F.col("positive")).alias("tn"))
    return c.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def bootstrap(rows: DataFrame, id_col: str, positive: Column, flagged: Column, resamples: int = 2000) -> DataFrame:
    """(resample, f1) of rows drawn anew: each counts Poisson(1) times by a hash of its id and the resample, so rows
    needn't meet and any engine draws alike. Only rows that are positive or flagged matter, and only sums are shuffled.
    """
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    kept = rows.where(positive | flagged).select(F.col(id_col).alias("_id"), positive.alias("_y"), flagged.alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "_id", "resample").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    kept = kept.withColumn("_u", u)
    draws = sum(((F.col("_u") >= s).cast("int") for s in steps[1:]), (F.col("_u") >= steps[0]).cast("int"))
    both = F.sum(F.when(F.col("_y") & F.col("_f"), draws).otherwise(0))
    return kept.groupBy("resample").agg(F.round(ratio(2 * both, both + F.sum(draws)), 6).alias("f1"))


def interval(samples: DataFrame, value: str, resamples: int) -> DataFrame:
    """(low, high): the values at 2.5 and 97.5 per cent of the sorted samples, as many as resamples, by index."""
    ordered = samples.agg(F.array_sort(F.collect_list(value)).alias("x"))
    return ordered.select(F.get("x", F.lit(int(0.025 * resamples))).alias("low"), F.get("x", F.lit(int(0.975 * resamples))).alias("high"))


def risk_coverage(rows: DataFrame, id_col: str, confidence: str, correct: str, steps: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    """(coverage, auto_n, defer_n, accuracy): what is decided alone if the surest share is, ties by id.

    Counts are of N times the share, rounded half to even, one at least. Rows are numbered within their confidence,
    and only one row a distinct confidence is summed up in order.
    """
    bins = rows.groupBy(confidence).agg(F.count(F.lit(1)).alias("covered"))
    ahead = running(bins.withColumn("own", F.col("covered")), confidence, True, ["covered"]).select(confidence, (F.col("covered") - F.col("own")).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy(confidence).orderBy(id_col)) + F.col("_ahead")
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    ranked = rows.join(ahead, confidence).withColumn("_rank", rank).crossJoin(F.broadcast(total)).withColumn("coverage", F.explode(F.array(*map(F.lit, steps))))
    auto = F.greatest(F.lit(1), F.bround(F.col("_total") * F.col("coverage")).cast("long"))
    kept = ranked.withColumn("auto_n", auto).groupBy("coverage", "auto_n", "_total").agg(F.count_if((F.col("_rank") <= F.col("auto_n")) & F.col(correct)).alias("_good"))
    return kept.select("coverage", "auto_n", (F.col("_total") - F.col("auto_n")).alias("defer_n"), F.round(F.col("_good") / F.col("auto_n"), 3).alias("accuracy"))


def calibration(rows: DataFrame, p: str, correct: str, bins: int = 10) -> DataFrame:
    """Per equal-width bin (the last closed): rows, mean confidence, accuracy and weighted gap; empty bins too."""
    spark = rows.sparkSession
    found = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    every = F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin"))).join(found, "bin", "left").crossJoin(F.broadcast(total))
    return every.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"), F.round(F.coalesce(F.col("n") / F.col("total") * F.abs(F.col("conf") - F.col("acc")), F.lit(0.0)), 6).alias("gap"))
