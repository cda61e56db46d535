"""Numeric claims in sentences, what evidence says of them, and the risk of a sentence along four axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sentences
from ..functions.lexicon import CATEGORIES, FALLS, RISES, TOPICS, VAGUE
from .industry import IndustryModule, merged_map, merged_terms, scalar

# A number with a unit that makes a claim; other names of units; weights and limits of the axes.
CLAIM = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(%|억원|조원|tCO2eq|만\s*tCO2eq|톤|ton|TJ|%p|건|명|배)"
UNIT_ALIASES = {"톤": "ton", "t": "ton", "tco2": "tco2eq", "tco₂eq": "tco2eq", "퍼센트": "%", "percent": "%", "킬로와트시": "kwh"}
WEIGHTS = {"D1_numeric": 0.40, "D2_modifier": 0.25, "D3_semantic": 0.25, "D5_timeseries": 0.10}
D1_FULL, D2_FULL, D3_LEAST, D5_FULL, NEAR = 0.15, 1.0, 0.35, 0.20, 25
LOW, MEDIUM = 0.25, 0.50


def canonical_unit(unit: Column) -> Column:
    """Without blanks, in lower case, by one name; empty where unknown."""
    plain = F.lower(F.replace(F.coalesce(unit, F.lit("")), F.lit(" "), F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair]), plain), plain)


def vague_phrases(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, VAGUE)), lambda p: F.contains(text, p))


def phrase_categories(text: Column) -> Column:
    """struct of the phrases found, by the regulators' categories."""
    return F.struct(*[F.filter(F.array(*map(F.lit, words)), lambda p: F.contains(text, p)).alias(name) for name, words in CATEGORIES.items()])


def _topic(before: Column, after: Column, sentence: Column) -> Column:
    """The topic word nearest before the number, else nearest after it, else the first anywhere in the sentence."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(w[::-1]).alias("r"), F.lit(c).alias("code")) for i, (w, _, c) in enumerate(TOPICS)])

    def nearest(text: Column, distance) -> Column:
        return F.array_min(F.transform(F.filter(table, lambda k: F.contains(text, k["w"])), lambda k: F.struct(distance(k).alias("d"), k["i"].alias("i"), k["code"].alias("code"))))["code"]

    return F.coalesce(nearest(before, lambda k: F.instr(F.reverse(before), k["r"])), nearest(after, lambda k: F.instr(after, k["w"])), nearest(sentence, lambda k: F.lit(0)))


def numeric_claims(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, sentence, nth, claim, number, unit, code): every number with a unit in every sentence.

    sentence counts from 0 within the text, nth within the sentence; code is null where no topic word is near.
    "만 tCO2eq" counts ten thousands of tCO2eq. Null and empty texts have no claims.
    """
    rows = texts.select(F.col(id_col), F.posexplode(sentences.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("sentence", "s")).where(F.col("s").rlike(CLAIM))
    found = F.arrays_zip(F.split("s", CLAIM, -1).alias("piece"), F.regexp_extract_all("s", F.lit(CLAIM), F.lit(0)).alias("hit"), F.regexp_extract_all("s", F.lit(CLAIM), F.lit(1)).alias("num"), F.regexp_extract_all("s", F.lit(CLAIM), F.lit(2)).alias("unit"))
    rows = rows.select(id_col, "sentence", "s", F.filter(found, lambda x: x["hit"].isNotNull()).alias("found"))
    begins = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + F.char_length(x["piece"]) + F.char_length(x["hit"])).alias("at"), F.array_append(a["out"], a["at"] + F.char_length(x["piece"])).alias("out")), lambda a: a["out"])
    rows = rows.withColumn("begins", begins).select(id_col, "sentence", "s", F.posexplode(F.arrays_zip(F.col("found").alias("f"), F.col("begins").alias("begin"))).alias("nth", "m"))
    begin, hit = F.col("m.begin"), F.col("m.f.hit")
    low = F.greatest(F.lit(0), begin - NEAR)
    before, after = F.substr("s", low + 1, begin - low), F.substr("s", begin + F.char_length(hit) + 1, F.lit(NEAR))
    unit = F.replace(F.col("m.f.unit"), F.lit(" "), F.lit(""))
    value, tens = F.replace(F.col("m.f.num"), F.lit(","), F.lit("")).cast("double"), unit.startswith("만")
    return rows.select(
        id_col, "sentence", "nth", F.concat_ws(" ", F.col("m.f.num"), F.col("m.f.unit")).alias("claim"), F.when(tens, value * 10000).otherwise(value).alias("number"),
        F.when(tens, F.substr(unit, F.lit(2))).otherwise(unit).alias("unit"), _topic(before, after, F.col("s")).alias("code"), F.col("s").alias("text"),
    )


def latest_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, code and unit the evidence of the latest period, the first inserted (smallest ord) of equals.

    nodes has the keys, node_id, code, value, unit, period and ord. One row a unit, so that a claim meets two rows at
    most, however many periods a code has.
    """
    rows = nodes.where("value IS NOT NULL").withColumn("canon", canonical_unit(F.col("unit")))
    best = F.max_by(F.struct("node_id", "value", "unit", "period", "ord"), F.struct("period", -F.col("ord"))).alias("node")
    return rows.groupBy(*keys, "code", "canon").agg(best)


def with_evidence(claims: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """claims with node: the most recent evidence of the claim's code in a unit that compares (the same, or unknown)."""
    held = latest_nodes(nodes, keys)
    same = held.withColumnsRenamed({"node": "_same", "canon": "_canon"})
    bare = held.where("canon = ''").drop("canon").withColumnRenamed("node", "_bare")
    met = claims.withColumn("_canon", canonical_unit(F.col("unit"))).join(same, [*keys, "code", "_canon"], "left").join(bare, [*keys, "code"], "left")
    later = F.when(F.col("_same").isNull() | (F.struct(F.col("_bare.period"), -F.col("_bare.ord")) > F.struct(F.col("_same.period"), -F.col("_same.ord"))), F.col("_bare")).otherwise(F.col("_same"))
    return met.withColumn("node", F.coalesce(later, "_same")).drop("_same", "_bare", "_canon")


def numeric_axis(evidenced: DataFrame, by: list[str]) -> DataFrame:
    """(by, d1, nodes): the largest relative difference over 15 %, at most 1, and the evidence that was met."""
    delta = F.when(F.col("node.value") != 0, F.abs(F.col("number") - F.col("node.value")) / F.abs(F.col("node.value")))
    ids = F.transform(F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct("nth", F.col("node.node_id").alias("x"))))), lambda s: s["x"])
    return evidenced.groupBy(*by).agg(F.round(F.least(F.lit(1.0), F.coalesce(F.max(delta), F.lit(0.0)) / D1_FULL), 4).alias("d1"), ids.alias("nodes"))


def trend_axis(claims: DataFrame, edges: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, d5): share of a claim's year-on-year edges that run against what its sentence says, over 20 %, at most 1.

    edges has the keys, target_id and yoy: an edge is a code's if its target's id holds the code. Edges without yoy count among a code's edges, but
    run against nothing. They are summed up for the codes that a company claims at all, so each edge meets these codes and not each claim.
    """
    codes = claims.where("code IS NOT NULL").select(*keys, "code").distinct()
    counts = codes.join(edges, keys).where(F.contains("target_id", F.col("code"))).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("yoy") > 0).alias("ups"), F.count_if(F.col("yoy") < 0).alias("downs"))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))
    against = F.when(says(FALLS), F.col("ups")).otherwise(0) + F.when(says(RISES), F.col("downs")).otherwise(0)
    met = claims.join(counts, [*keys, "code"])
    return met.groupBy(*by).agg(F.round(F.least(F.lit(1.0), F.sum(against) / F.sum("n") / D5_FULL), 4).alias("d5"))


def modifier_axis(text: Column, terms: Column | None = None, full: Column | None = None) -> Column:
    """Vague phrases (or other terms, an array) in the text, of as many as are full marks, at most 1."""
    found = vague_phrases(text) if terms is None else F.filter(terms, lambda p: F.contains(text, p))
    return F.round(F.least(F.lit(1.0), F.size(found) / (F.lit(D2_FULL) if full is None else full)), 4)


def semantic_axis(similarity: Column) -> Column:
    """How far the best of the three nearest chunks stays below 0.35; a half where nothing was retrieved (null)."""
    return F.when(similarity.isNull(), 0.5).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), D3_LEAST - similarity) / D3_LEAST), 4))


def risk_vector(d1: Column, d2: Column, d3: Column, d5: Column, weights: dict[str, Column] | None = None) -> Column:
    """struct<risk, level, top_axis, high_axes>: weighted risk, its level, the first largest axis, axes of a half or more."""
    weights = weights or {name: F.lit(w) for name, w in WEIGHTS.items()}
    scores = dict(zip(WEIGHTS, (d1, d2, d3, d5)))
    # Scores have four digits and weights two: their sum is taken in decimals, so a half rounds up wherever it is worked out.
    parts = [weights[name].cast("decimal(4,2)") * scores[name].cast("decimal(9,4)") for name in WEIGHTS]
    risk = F.round(sum(parts[1:], parts[0]), 4).cast("double")
    axes = F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())])
    high = F.transform(F.filter(axes, lambda a: -a["s"] >= MEDIUM), lambda a: a["name"])
    return F.struct(risk.alias("risk"), F.when(risk < LOW, "low").when(risk < MEDIUM, "medium").otherwise("high").alias("level"), F.array_min(axes)["name"].alias("top_axis"), high.alias("high_axes"))


def sentence_risks(texts: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], similarity: DataFrame | None = None, id_col: str = "id", text_col: str = "text", module: str | None = None, registry: Sequence[IndustryModule] = ()) -> DataFrame:
    """One row a sentence: (id, sentence, text, d1, d2, d3, d5, risk, level, top_axis, high_axes, nodes).

    texts has the keys too. similarity, where given, has (id, sentence, sim): the best similarity to retrieved chunks. module, where given, is a
    column of texts with the key of an industry in the registry, whose terms `vague`, scalar `d2_full` and map `weights` hold for its texts.
    """
    rows = texts.select(id_col, *keys, *([module] if module else []), F.posexplode(sentences.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("sentence", "text"))
    claims = numeric_claims(texts, id_col, text_col).join(texts.select(id_col, *keys), id_col) if keys != [id_col] else numeric_claims(texts, id_col, text_col)
    by = [id_col, "sentence"]
    scored = rows.join(numeric_axis(with_evidence(claims, nodes, keys), by), by, "left").join(trend_axis(claims, edges, keys, by), by, "left")
    scored = scored.join(similarity, by, "left") if similarity is not None else scored.withColumn("sim", F.lit(None).cast("double"))
    terms = full = weights = None
    if module:
        own = F.col(module)
        terms, full, weights = merged_terms(own, "vague", VAGUE, registry), scalar(own, "d2_full", D2_FULL, registry), merged_map(own, "weights", WEIGHTS, registry)
    scored = scored.withColumns({"d1": F.coalesce("d1", F.lit(0.0)), "d2": modifier_axis(F.col("text"), terms, full), "d3": semantic_axis(F.col("sim")), "d5": F.coalesce("d5", F.lit(0.0))})
    return scored.withColumn("v", risk_vector(*map(F.col, ("d1", "d2", "d3", "d5")), weights)).select(*by, "text", "d1", "d2", "d3", "d5", "v.*", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def worst_sentences(risks: DataFrame, id_col: str = "id") -> DataFrame:
    """Of each text the sentence of the highest risk, the first of equals."""
    return risks.groupBy(id_col).agg(F.max_by(F.struct("sentence", "text", "risk", "level", "top_axis"), F.struct("risk", -F.col("sentence"))).alias("w")).select(id_col, "w.*")


def checked_claims(claims: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """claims with delta_pct and verdict against reported items (keys, code, value, unit): unverifiable without a code
    or a number, approximate in other units, ok within ten per cent, else a mismatch. A reported 0 differs by nothing.
    """
    met = claims.join(items.select(*keys, "code", F.col("value").alias("_value"), F.col("unit").alias("_unit")), [*keys, "code"], "left")
    squeezed = lambda u: F.lower(F.replace(F.coalesce(u, F.lit("")), F.lit(" "), F.lit("")))
    other = (squeezed(F.col("_unit")) != "") & (squeezed(F.col("unit")) != "") & (squeezed(F.col("_unit")) != squeezed(F.col("unit")))
    delta = F.when(F.col("_value").isNull() | other, None).when(F.col("_value") == 0, 0.0).otherwise((F.col("number") - F.col("_value")) / F.abs("_value") * 100)
    verdict = F.when(F.col("code").isNull() | F.col("_value").isNull(), "unverifiable").when(other, "approximate").when(F.abs(delta) <= 10, "ok").otherwise("mismatch")
    return met.withColumns({"delta_pct": delta, "verdict": verdict}).drop("_value", "_unit")


def document_risks(texts: DataFrame, checked: DataFrame, similarity: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, risk): 0 to 100 from mismatches, unverifiable claims, vague phrases and distance from the report; similarity has (id, sim)."""
    n = checked.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "mismatch").alias("bad"), F.count_if(F.col("verdict") == "unverifiable").alias("open"))
    whole = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    vague = F.aggregate(sentences.sentences(F.coalesce(F.col(text_col), F.lit(""))), F.lit(0), lambda a, s: a + F.size(vague_phrases(s)))
    parts = 0.45 * F.least(F.lit(1.0), F.coalesce("bad", F.lit(0)) / whole * 2.0) + 0.10 * F.least(F.lit(1.0), F.coalesce("open", F.lit(0)) / whole)
    parts = parts + 0.25 * F.least(F.lit(1.0), vague / 4.0) + 0.20 * F.greatest(F.lit(0.0), 1.0 - F.coalesce("sim", F.lit(0.0)))
    return texts.join(n, id_col, "left").join(similarity, id_col, "left").select(id_col, F.round(100 * parts, 1).alias("risk"))
