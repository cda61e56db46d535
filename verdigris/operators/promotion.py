"""Late evidence merged into what a company has shown, answers that follow from it, and where each figure comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands for a value where only a clause of a document was found, a survey's word for no answer, a dash for what is
# missing, and whether a place is known.
CLAUSE, BLANK_ANSWER, MISSING = "문서 조항 확인", "미입력", "—"
PLACED, UNPLACED = "bbox 연결됨", "좌표 미연결"


def _ordered(value: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def _ids(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def survey_clauses(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses (keys, code, node_id, ord) from survey answers (keys, qid, code, text, ord): those that were given."""
    given = ~F.coalesce(F.trim("text"), F.lit("")).isin("", BLANK_ANSWER) & F.col("code").isNotNull()
    return answers.where(given).select(*keys, "code", F.concat_ws(":", F.lit("survey"), *keys, "qid").alias("node_id"), "ord")


def promoted(items: DataFrame, taxonomy: DataFrame, evidence: DataFrame, clauses: DataFrame, keys: list[str]) -> DataFrame:
    """items after late evidence, an upsert by (keys, code): (keys, code, status, value, unit, note, node_ids, no_evidence, promoted).

    items: keys, code, status (mapped, beyond or missing), value, unit, note, node_ids, no_evidence. evidence: keys, code, node_id, value, unit, period,
    confidence, ord; clauses: keys, code, node_id, ord; taxonomy: code, unit, in_profile. What is shown keeps its value and gains the ids, in the order
    own, evidence, clauses, no id twice; evidence (not a clause) ends its no_evidence. What isn't is promoted if the taxonomy has the code: with the
    value of the latest, surest, last evidence, else as a clause, as mapped within the profile and beyond outside of it. Evidence is summed up by
    code before the one outer join. Running it again on its own result changes nothing but promoted, so a replay ends in the same state.
    """
    by = [*keys, "code"]
    late = evidence.groupBy(*by).agg(_ordered("node_id", "ord").alias("_e"), F.max_by(F.struct("value", "unit"), F.struct("period", "confidence", "ord")).alias("_best"))
    said = clauses.groupBy(*by).agg(_ordered("node_id", "ord").alias("_c"))
    met = items.withColumn("_has", F.lit(True)).join(late.join(said, by, "full"), by, "full")
    known = F.broadcast(taxonomy.select("code", F.col("unit").alias("_unit"), "in_profile")) if taxonomy.count() <= 4096 else taxonomy.select("code", F.col("unit").alias("_unit"), "in_profile")
    met = met.join(known, "code", "left")
    shown = F.coalesce(F.col("status").isin("mapped", "beyond"), F.lit(False))
    found = F.col("_e").isNotNull() | F.col("_c").isNotNull()
    lifts = ~shown & found & F.col("in_profile").isNotNull()
    quantity = F.col("_best").isNotNull()
    ids = F.array_distinct(F.concat(_ids(F.col("node_ids")), _ids(F.col("_e")), _ids(F.col("_c"))))
    unit = F.when(quantity, F.coalesce(F.when(F.col("_best.unit") != "", F.col("_best.unit")), "_unit", F.lit(""))).otherwise("")
    out = met.where(F.col("_has") | lifts).select(
        *by, F.when(lifts, F.when(F.col("in_profile"), "mapped").otherwise("beyond")).otherwise(F.col("status")).alias("status"),
        F.when(lifts, F.col("_best.value")).otherwise(F.col("value")).alias("value"), F.when(lifts, unit).otherwise(F.col("unit")).alias("unit"),
        F.when(lifts & ~quantity, CLAUSE).otherwise(F.col("note")).alias("note"), F.when(shown | lifts, ids).otherwise(_ids(F.col("node_ids"))).alias("node_ids"),
        (F.coalesce("no_evidence", F.lit(False)) & ~(shown & quantity)).alias("no_evidence"), F.when(lifts, F.when(quantity, "quantity").otherwise("clause")).alias("promoted"),
    )
    return out


def _shown(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: its codes that are shown, with their evidence; a taxonomy's, so an array of bounded length."""
    return items.where("status <> 'missing'").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("code", _ids(F.col("node_ids"))))).alias("_shown"))


def _evidence(codes: Column, shown: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(codes, lambda c: _ids(F.try_element_at(shown, c)))))


def presence_answers(questions: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, qid, present, node_ids, status) of questions (keys, qid, codes, narrative) that ask whether something is there.

    present are the question's codes that are shown, in its order. With evidence an answer is verified, without self-reported; nothing shown leaves
    it insufficient, or to a person where the question wants a narrative.
    """
    met = questions.join(_shown(items, keys), keys, "left")
    present = F.filter("codes", lambda c: F.coalesce(F.map_contains_key("_shown", c), F.lit(False)))
    met = met.withColumn("present", present).withColumn("node_ids", _evidence(F.col("present"), F.col("_shown")))
    status = F.when(F.size("present") == 0, F.when(F.coalesce("narrative", F.lit(False)), "hitl_required").otherwise("insufficient")).when(F.size(_ids(F.col("node_ids"))) > 0, "verified").otherwise("self_reported")
    return met.select(*keys, "qid", "present", _ids(F.col("node_ids")).alias("node_ids"), status.alias("status"))


def multi_select_answers(questions: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, qid, ticked, open, node_ids, status) of questions (keys, qid, options: array<struct<label, codes>>): an option is ticked where one of
    its codes is shown; the evidence is that of all such codes, in the order of the options."""
    met = questions.join(_shown(items, keys), keys, "left")
    hit = lambda o: F.filter(o["codes"], lambda c: F.coalesce(F.map_contains_key("_shown", c), F.lit(False)))
    told = F.transform("options", lambda o: F.struct(o["label"].alias("label"), hit(o).alias("hit")))
    met = met.withColumn("_told", told)
    pick = lambda on: F.transform(F.filter("_told", lambda t: (F.size(t["hit"]) > 0) == on), lambda t: t["label"])
    ids = _ids(_evidence(F.flatten(F.transform("_told", lambda t: t["hit"])), F.col("_shown")))
    met = met.select(*keys, "qid", pick(True).alias("ticked"), pick(False).alias("open"), ids.alias("node_ids"))
    return met.withColumn("status", F.when(F.size("ticked") == 0, "insufficient").when(F.size("node_ids") > 0, "verified").otherwise("self_reported"))


def provenance(points: DataFrame, nodes: DataFrame, id_col: str = "point_id") -> DataFrame:
    """(id, step, key, value, linked): four ordered steps of each data point (id, value, unit, node_ids): claim, node, source, location.

    nodes: node_id, file, source, origin, box. Of a point's links the first that has a place stands for it, else the first. A node that the
    index doesn't know stands as its own file, from filings. What is missing is named by a dash. One join for all steps.
    """
    links = points.select(id_col, F.posexplode("node_ids").alias("_at", "node_id"))
    index = nodes.select("node_id", F.struct(F.coalesce(F.when(F.col("file") != "", F.col("file")), F.when(F.col("source") != "", F.col("source")), "node_id").alias("file"), "origin", "box").alias("_n"))
    raw = F.struct(F.col("node_id").alias("file"), F.lit("dart").alias("origin"), F.lit(None).cast(nodes.schema["box"].dataType).alias("box"))
    met = links.join(index, "node_id", "left").withColumn("_n", F.coalesce("_n", raw))
    first = met.groupBy(id_col).agg(F.min_by(F.struct("node_id", "_n"), F.struct(F.col("_n.box").isNull(), F.col("_at"))).alias("_l"))
    text = lambda c: F.coalesce(F.when(c != "", c), F.lit(MISSING))
    claim = F.trim(F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("unit", F.lit(""))))
    placed = F.coalesce(F.col("_l._n.box").isNotNull(), F.lit(False))
    step = lambda n, key, value, linked: F.struct(F.lit(n).alias("step"), F.lit(key).alias("key"), value.alias("value"), linked.alias("linked"))
    unknown = F.lit(None).cast("boolean")
    steps = F.array(
        step(1, "claim", text(claim), unknown), step(2, "node", text(F.col("_l.node_id")), unknown),
        step(3, "source", F.coalesce(F.when(F.col("_l._n.file") != "", F.col("_l._n.file")), F.when(F.col("_l._n.origin") != "", F.col("_l._n.origin")), F.lit(MISSING)), unknown),
        step(4, "location", F.when(placed, PLACED).otherwise(UNPLACED), placed),
    )
    return points.select(id_col, "value", "unit").join(first, id_col, "left").select(id_col, F.explode(steps).alias("s")).select(id_col, "s.*")


def with_geometry(metrics: DataFrame, pairs: DataFrame, doc: str = "doc") -> DataFrame:
    """metrics (doc, ord, hint, value, box, page) with box and page of the pairs (doc, ord, label, value, box, page) they were read from.

    A metric with a box keeps it. One whose hint is a pair's label has that pair's. The others are dealt out one to one: of those with
    equal values (to six digits) the k-th in reading order has the k-th pair of that value, so no pair serves two of them and no row is compared
    with all others. A page that is known stays.
    """
    key = lambda c: F.round(F.col(c).try_cast("double"), 6)
    labelled = pairs.groupBy(doc, F.col("label").alias("hint")).agg(F.max_by(F.struct("box", "page"), "ord").alias("_label"))
    met = metrics.join(labelled, [doc, "hint"], "left").withColumn("_open", F.col("box").isNull() & F.col("_label").isNull() & key("value").isNotNull())
    turn = lambda *by: F.row_number().over(Window.partitionBy(doc, *by).orderBy("ord"))
    met = met.withColumns({"_v": key("value")}).withColumn("_k", F.when(F.col("_open"), turn("_v", "_open")))
    numbered = pairs.withColumn("_v", key("value")).where("_v IS NOT NULL").withColumn("_k", turn("_v")).select(doc, "_v", "_k", F.struct("box", "page").alias("_value"))
    met = met.join(numbered, [doc, "_v", "_k"], "left")
    given = F.when(F.col("box").isNull(), F.coalesce("_label", "_value"))
    return met.withColumns({"box": F.coalesce("box", given["box"]), "page": F.coalesce("page", given["page"])}).select(*metrics.columns)
