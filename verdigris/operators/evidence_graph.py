"""Evidence as nodes and edges: reported figures, figures of the year before worked out from text, derived emissions,
cross-checks between origins, and the figure that stands for a code.

nodes: keys (such as corp), node_id, metric, value, unit, period, origin, source_file, source, raw_text, confidence, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import pct_diff

# Words that tell a metric; the first metric with a word in the text wins.
METRIC_WORDS = {
    "E-2-1": ["원부자재"], "E-2-2": ["재생 원부자재", "고철", "스크랩"], "E-3-1": ["온실가스", "Scope 1+2", "Scope1+2", "tCO2", "배출량"],
    "E-4-1": ["에너지 사용량", "에너지사용"], "E-4-2": ["재생에너지", "RE100"], "E-5-1": ["취수량", "취수"],
    "E-5-2": ["재사용 용수", "용수 재사용", "공정 내 재사용"], "E-6-1": ["폐기물 배출", "슬래그"], "E-6-2": ["폐기물 재활용", "재활용 비율"],
    "E-7-1": ["대기오염", "NOx", "SOx", "비산먼지"], "E-7-2": ["수질오염", "COD", "SS"],
    "S-2-1": ["신규 채용", "채용 인원", "고용 유지", "정규직 전환"], "S-2-2": ["정규직 비율", "비정규직 비율", "기간제"],
    "S-2-3": ["자발적 이직률", "이직률", "퇴사율"], "S-2-4": ["교육훈련비", "1인당 교육비", "인당 교육훈련"],
    "S-2-5": ["복리후생비", "1인당 복리후생", "복지비"], "S-2-6": ["노동조합", "노조 가입률", "단체협약", "결사의 자유"],
    "S-3-1": ["여성 구성원", "여성 비율", "여성 인력", "여성 임직원"], "S-3-2": ["여성 급여", "남녀 임금격차", "성별 임금"],
    "S-3-3": ["장애인 고용률", "장애인 고용", "장애인 의무고용"], "S-4-1": ["안전보건 경영", "ISO 45001", "산업안전보건", "안전보건 추진체계"],
    "S-4-2": ["재해율", "산업재해", "사망만인율", "LTIFR", "업무상 재해"], "S-7-2": ["봉사활동 참여", "임직원 봉사", "봉사 참여율"],
    "S-8-2": ["개인정보 침해", "개인정보 유출", "정보 유출 건수"], "S-9-1": ["사회 법규 위반", "노동 법규 위반", "사회 과징금"],
    "G-1-2": ["사외이사"], "G-1-4": ["여성 이사"], "G-2-1": ["출석률", "이사회 출석"], "G-3-4": ["배당"],
}
# How text says by how much a figure changed; emission factors by unit; codes whose derived figures add up.
CHANGE = r"전년\s*대비\s+(?:각각\s+)?(\d+\.?\d*)\s*%(p?)\s*(?:,\s*\d+\.?\d*\s*%p?\s*)?(감소|하락|증가|상승|개선|절감)"
DOWN = ["감소", "하락", "절감"]
FACTORS = {"kwh": 0.4781 / 1000, "mj": 0.0000561}
ADDITIVE = ["E-3-1"]


def first_metric(text: Column, words: dict[str, list[str]] = METRIC_WORDS) -> Column:
    """The first metric of which a word is in the text, null where there is none."""
    return F.coalesce(*[F.when(text.rlike("|".join(w.replace("+", "[+]") for w in ws)), m) for m, ws in words.items()])


def numeric_items(items: DataFrame) -> DataFrame:
    """Reported items whose value is a number; what only looks like one (a string) stays out."""
    return items.where(F.col("value").try_cast("double").isNotNull() & ~F.coalesce(F.col("is_text"), F.lit(False))).withColumn("value", F.col("value").try_cast("double"))


def matching_nodes(nodes: DataFrame, keywords: list[str], period: int | None = None) -> DataFrame:
    """Nodes of a metric among the keywords, or with one of them in metric, text or unit."""
    hay = F.concat_ws(" ", "metric", F.coalesce("raw_text", F.lit("")), F.coalesce("unit", F.lit("")))
    words = F.array(*map(F.lit, keywords))
    found = nodes.where(F.array_contains(words, F.col("metric")) | F.exists(words, lambda w: F.contains(hay, w)))
    return found if period is None else found.where(F.col("period") == period)


def matching_metrics(nodes: DataFrame, keywords: list[str], period: int | None = None) -> DataFrame:
    """Nodes with a keyword in their metric, in any case, by period."""
    found = nodes.where(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda w: F.contains(F.lower("metric"), w)))
    return (found if period is None else found.where(F.col("period") == period)).orderBy("period", "ord")


def inferred_priors(nodes: DataFrame, snippets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(priors, edges) from snippets (keys, period, ord, text) that say how a figure changed over the year before.

    A change of x % gives prior = current / (1 + x / 100), one of x %p gives current - x. Each snippet makes an edge;
    of snippets for one figure, the first makes the node. Snippets without a known metric or figure make neither.
    """
    part = lambda i: F.regexp_extract("text", CHANGE, i)
    said = snippets.where(F.col("text").rlike(CHANGE)).withColumns({"metric": first_metric(F.col("text")), "_pct": part(1).cast("double"), "_points": part(2) == "p", "_down": part(3).isin(DOWN)}).where("metric IS NOT NULL")
    said = said.withColumn("yoy", F.when(F.col("_down"), -F.col("_pct")).otherwise(F.col("_pct")))
    held = nodes.where("origin = 'report'").select(*keys, "metric", "period", F.col("node_id").alias("target_id"), F.col("value").alias("_now"), F.col("unit").alias("_unit"))
    met = said.join(held, [*keys, "metric", "period"]).where(F.col("_points") | (F.col("yoy") != -100))
    prior = F.when(F.col("_points"), F.col("_now") - F.col("yoy")).otherwise(F.col("_now") / (1 + F.col("yoy") / 100))
    met = met.withColumns({"source_id": F.concat_ws("_", *keys, "metric", F.col("period") - 1, F.lit("inferred")), "_prior": F.round(prior, 4)})
    edges = met.select(*keys, "metric", "source_id", "target_id", "ord", F.lit("timeseries").alias("edge_type"), F.round("yoy", 3).alias("yoy"), F.lit(1).alias("years_gap"))
    first = met.groupBy(*keys, "source_id").agg(F.min_by(F.struct("metric", F.col("_prior").alias("value"), F.col("_unit").alias("unit"), (F.col("period") - 1).alias("period"), "text", "ord"), "ord").alias("x"))
    priors = first.select(*keys, F.col("source_id").alias("node_id"), "x.metric", "x.value", "x.unit", "x.period", F.lit("inferred").alias("origin"), F.col("x.text").alias("raw_text"), "x.ord")
    return priors, edges


def derived_emissions(nodes: DataFrame, keys: list[str], factors: dict[str, float] = FACTORS) -> DataFrame:
    """Emissions (E-3-1, tCO2eq) worked out from energy nodes by their unit, believed a little less."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]), F.lower("unit"))
    rows = nodes.where("metric = 'E-4-1'").withColumn("_factor", factor).where("_factor IS NOT NULL")
    suffix = F.substring(F.sha1(F.concat_ws("||", *keys, F.lit("E-3-1"), "period", "origin", "node_id").cast("binary")), 1, 10)
    return rows.select(*keys, F.concat(F.lit("derived_"), suffix).alias("node_id"), F.lit("E-3-1").alias("metric"), F.round(F.col("value") * F.col("_factor"), 3).alias("value"), F.lit("tCO2eq").alias("unit"), "period", "origin", "source_file", F.concat(F.lit("derived_from:"), "node_id").alias("source"), (F.col("confidence") * 0.95).alias("confidence"), "ord")


def cross_checks(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """An edge from each earlier node to a later one of the same metric and period, if the earlier one is reported
    ("dart") or of another origin; diff_pct to one decimal, as it is shown.
    """
    cols = ["node_id", "value", "origin", "ord"]
    a = nodes.select(*keys, "metric", "period", *[F.col(c).alias(f"_{c}") for c in cols])
    met = a.join(nodes.select(*keys, "metric", "period", *cols), [*keys, "metric", "period"]).where("_ord < ord AND (_origin = 'dart' OR _origin <> origin)")
    return met.select(*keys, "metric", "period", F.col("_node_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("cross_check").alias("edge_type"), F.round(pct_diff(F.col("value"), F.col("_value")), 1).alias("diff_pct"))


def cross_check_risk(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, risk): 0.4 where some cross-check of the metric is more than 5 % apart, else 0."""
    return edges.groupBy(*keys, "metric").agg(F.when(F.max("diff_pct") > 5.0, 0.4).otherwise(0.0).alias("risk"))


def data_points(nodes: DataFrame, keys: list[str], d1: DataFrame | None = None) -> DataFrame:
    """The figure that stands for each metric: of the latest period, reported ones first, then the most confident (the
    first inserted of equals). Where all figures of an additive metric are derived, their sum stands.

    Returns keys, metric, value, unit, period, confidence, verification, d1_risk and links, the evidence in order.
    d1, where given, has the keys, metric and d1.
    """
    newest = nodes.groupBy(*keys, "metric").agg(F.max("period").alias("period"))
    at = nodes.join(newest, [*keys, "metric", "period"]).withColumn("_derived", F.coalesce(F.col("source").startswith("derived_from:"), F.lit(False)))
    pick = F.min_by(F.struct("value", "unit", "confidence", "origin", "source_file"), F.struct((F.col("origin") != "dart").alias("late"), (-F.col("confidence")).alias("less"), "ord"))
    links = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("source_file", F.concat("node_id", F.lit(".json"))).alias("x")))), lambda s: s["x"])
    best = at.groupBy(*keys, "metric", "period").agg(pick.alias("p"), F.bool_and("_derived").alias("_all"), F.count(F.lit(1)).alias("_n"), F.round(F.sum("value"), 3).alias("_sum"), links.alias("links"))
    best = best.join(d1, [*keys, "metric"], "left").withColumn("d1", F.coalesce("d1", F.lit(0.0))) if d1 is not None else best.withColumn("d1", F.lit(0.0))
    value = F.when(F.col("metric").isin(ADDITIVE) & F.col("_all") & (F.col("_n") > 1), F.col("_sum")).otherwise(F.col("p.value"))
    proven = (F.col("p.origin") == "dart") | (F.col("p.source_file").isNotNull() & (F.col("d1") < 0.2))
    verification = F.when(F.col("d1") >= 0.5, "unverified").when(proven, "verified").otherwise("estimated")
    return best.select(*keys, "metric", value.alias("value"), "p.unit", "period", F.round("p.confidence", 3).alias("confidence"), verification.alias("verification"), F.round("d1", 3).alias("d1_risk"), "links")
