"""Retrieval by keywords (BM25) and by hashed vectors in one pass, fusion of ranked lists, and gates on what is found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import words
from .toplists import K1, B, top_lists

# Weights and limits of fusion and gates.
KEYWORDS, VECTORS, RRF, LATER = 0.55, 0.45, 60, 0.7
LEAST_SCORE, LEAST_MARGIN, LEAST_OVERLAP, STRONG = 0.54, 0.12, 0.2, 0.95
STOP_TERMS = ["수치", "실적", "성과", "지표", "기준", "관련", "현황", "데이터", "운영"]
TOKEN = "[0-9A-Za-z가-힣]+"


def word_pairs(text: Column) -> Column:
    """Words between blanks, and pairs of neighbouring characters that aren't both blank."""
    chars = F.split(text, "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.concat(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.filter(pairs, lambda p: ~p.rlike(r"^\s*$")))


def bucket(term: Column) -> Column:
    """md5 of the term modulo 256."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 31, 2), 16, 10).cast("int")


def times(items: Column, item: Column) -> Column:
    """How often an item stands in an array."""
    return F.size(items) - F.size(F.array_remove(items, item))


def norm(buckets: Column) -> Column:
    """Length of the vector of bucket counts: sorted buckets stand in runs, and a run of n adds 1 + 3 + ... = n squared."""
    first = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, b: Column) -> Column:
        run = F.when(a["last"] == b, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(b.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).cast("long").alias("sum"))

    return F.sqrt(F.aggregate(F.array_sort(buckets), first, step, lambda a: a["sum"]))


def scores(docs: DataFrame, queries: DataFrame, index: list[str], tokens: Callable[[Column], Column] = words, kept: tuple[str, ...] = ()) -> DataFrame:
    """(index, query_id, doc_id, kept, bm25, cosine) of the documents that share a term or a bucket with a query of their index.

    For many small indexes (a company's texts, met by a few queries): docs has the index columns, doc_id, text and the kept columns, queries the
    index columns, query_id and text, and each index has its own statistics. Texts are dealt out by index once; a document then meets its index's
    queries whole, and only terms that both have become rows. One index over all texts is `toplists.top_lists`'s task. A term that a query
    repeats counts each time. Null and empty texts match nothing.
    """

    def bags(texts: DataFrame, *columns: str) -> DataFrame:
        """The columns, a text's terms w, their buckets b, and the norm of these."""
        made = texts.select(*columns, tokens(F.coalesce("text", F.lit(""))).alias("w")).select(*columns, "w", F.transform("w", bucket).alias("b"))
        return made.withColumn("norm", norm(F.col("b")))

    own, asker = Window.partitionBy(*index), Window.partitionBy(*index, "query_id", "term")
    made = bags(docs.select(*index, "doc_id", *kept, "text").repartition(*index), *index, "doc_id", *kept).withColumn("n_terms", F.size("w"))
    made = made.withColumns({"n_docs": F.count(F.lit(1)).over(own), "avg_terms": F.avg(F.col("n_terms").cast("double")).over(own)})
    asked = bags(queries, *index, "query_id").select(*index, "query_id", F.col("w").alias("qw"), F.col("b").alias("qb"), F.col("norm").alias("length"))
    dot = F.aggregate(F.array_intersect("b", "qb"), F.lit(0).cast("long"), lambda a, x: a + times(F.col("b"), x) * times(F.col("qb"), x))
    pairs = made.join(asked, index).where(F.arrays_overlap("b", "qb"))
    pairs = pairs.select(*index, "query_id", "doc_id", *kept, "n_terms", "n_docs", "avg_terms", "w", "qw", F.array_intersect("w", "qw").alias("both"), (dot / F.col("norm") / F.col("length")).alias("cosine"))
    # A document that shares buckets only has one row without a term.
    met = pairs.select("*", F.explode_outer("both").alias("term")).withColumns({"tf": times(F.col("w"), F.col("term")), "qtf": times(F.col("qw"), F.col("term"))}).drop("w", "qw", "both")
    met = met.withColumn("df", F.count("term").over(asker))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    dl = F.greatest(F.col("n_terms"), F.lit(1)) / F.greatest(F.col("avg_terms"), F.lit(1.0))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * dl))
    summed = met.groupBy(*index, "query_id", "doc_id").agg(*[F.first(c).alias(c) for c in kept], F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25"), F.max("cosine").alias("cosine"))
    return summed.withColumns({"bm25": F.round("bm25", 6), "cosine": F.round("cosine", 6)})


def ranked(scored: DataFrame, k: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, kind, doc_id, kept, score, rank): the k best of each query by keywords (above 0) and by vectors, in one frame."""
    kinds = F.array(F.struct(F.lit("bm25").alias("kind"), F.col("bm25").alias("score")), F.struct(F.lit("vector").alias("kind"), F.col("cosine").alias("score")))
    rows = scored.select("query_id", "doc_id", *kept, F.explode(kinds).alias("x")).select("query_id", "x.kind", "doc_id", *kept, "x.score").where("score > 0")
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(scored: DataFrame, score: str, k: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def min_max(score: str, *keys: str) -> Column:
    """Scaled to 0..1 within a list; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def fuse(lists: DataFrame, k: int, bonus: DataFrame | Column | None = None) -> DataFrame:
    """The k best of each query by the weighted sum of its scaled lists; bonus, rows (query_id, doc_id, bonus) or made of the lists' columns, is
    added to what was found.
    """
    weight = F.when(F.col("kind") == "bm25", KEYWORDS).otherwise(VECTORS)
    of_lists = [F.max(bonus).alias("bonus")] if isinstance(bonus, Column) else []
    summed = lists.withColumn("s", min_max("score", "query_id", "kind") * weight).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), *of_lists)
    if bonus is not None:
        summed = (summed if of_lists else summed.join(bonus, ["query_id", "doc_id"], "left")).withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    return top(summed.withColumn("score", F.round("score", 4)), "score", k)


def rrf(lists: DataFrame, weight: Column, k: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank), each row by its weight, scaled so that the best has 1."""
    summed = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (RRF + F.col("rank"))), 9).alias("s"))
    best = F.max("s").over(Window.partitionBy("query_id"))
    return top(summed.withColumn("score", F.round(F.col("s") / best, 6)).drop("s"), "score", k)


def query_bonus(code: Column, source: Column, query: Column) -> Column:
    """0.35 where the query names the chunk's code, 0.05 for structured sources."""
    named = F.coalesce((code != "") & F.contains(query, code), F.lit(False))
    return F.when(F.trim(query) == "", 0.0).otherwise(F.when(named, 0.35).otherwise(0.0) + F.when(source == "dart_struct", 0.05).otherwise(0.0))


def query_variants(query: Column) -> Column:
    """The query, each of its parts between commas, and each part asking for figures; at most eight, no repeats."""
    clean = lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit(","), F.lit(" ")), r"\s+", " "))
    parts = F.filter(F.transform(F.split(query, ","), F.trim), lambda p: F.length(p) >= 2)
    found = F.concat(F.array(clean(query)), F.flatten(F.transform(parts, lambda p: F.array(clean(p), clean(F.concat(p, F.lit(" 수치")))))))
    return F.slice(F.array_distinct(F.filter(found, lambda v: v != "")), 1, 8)


def covers_query(query: Column, text: Column) -> Column:
    """Whether a text holds a query's terms: one, or two of three and more. The first term is let go if it isn't there and
    others are; short terms and those that say nothing don't count. A query without terms is covered.
    """
    flat = F.array_join(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), "")
    terms = F.array_distinct(F.regexp_extract_all(query, F.lit(f"({TOKEN})"), F.lit(1)))
    rest = F.when((F.size(terms) >= 2) & ~F.contains(flat, F.get(terms, F.lit(0))), F.slice(terms, F.lit(2), F.size(terms))).otherwise(terms)
    kept = F.filter(rest, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_TERMS))
    hit = F.size(F.filter(kept, lambda t: F.contains(flat, t)))
    return (F.size(kept) == 0) | (hit >= F.when(F.size(kept) >= 3, 2).otherwise(1))


def has_figure(text: Column) -> Column:
    """A digit in the text, a tag in brackets at its start apart, after "수치:" where that stands."""
    bare = F.trim(F.regexp_replace(text, r"^\[[^\]]+\]\s*", ""))
    return F.when(F.contains(bare, F.lit("수치:")), F.regexp_replace(bare, r"(?s)^.*?수치:", "")).otherwise(bare).rlike(r"\d")


def gate(found: DataFrame, tier: int = 1, max_tier: int = 2) -> DataFrame:
    """found with decision, hard_fails and soft_flags of the retrieval gate, a row a query.

    found has query, area_terms, top_text (null: nothing found), source, report_year, top1, tail, n (results) and overlap
    of the two methods (null where only one was asked). No result, a low first score, no area term, no query term or no
    figure are hard; a small margin, no period, no source, a small overlap are soft. Hard fails, or two soft flags,
    escalate while tiers are left and then go to a person, but for a strong hit of a structured source.
    """
    text, none = F.coalesce("top_text", F.lit("")), F.col("top_text").isNull()
    margin = F.greatest(F.lit(0.0), F.col("top1") - F.when(F.col("n") > 1, F.col("tail")).otherwise(0.0))
    area = F.exists("area_terms", lambda t: F.contains(F.lower(text), F.lower(t)))
    period = text.rlike(r"(19|20)\d{2}") | (F.coalesce(F.trim("report_year"), F.lit("")) != "")
    asked = F.col("query") != ""
    covered = covers_query(F.col("query"), text)
    hard = F.when(none, F.array(F.lit("R0_no_corp_hits"))).otherwise(F.array_compact(F.array(
        F.when(F.col("top1") < LEAST_SCORE, "R1_low_top1_score"), F.when(~area, "R3_area_keyword_missing"), F.when(asked & ~covered, "R3_query_keyword_missing"), F.when(~has_figure(text), "R3_numeric_evidence_missing"),
    )))
    soft = F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(margin < LEAST_MARGIN, "R2_low_margin"), F.when(~period, "R3_period_missing"), F.when(F.coalesce("source", F.lit("")) == "", "R3_source_missing"), F.when(F.coalesce(F.col("overlap") < LEAST_OVERLAP, F.lit(False)), "R4_low_method_overlap"),
    )))
    rows = found.withColumns({"hard_fails": hard, "soft_flags": soft})
    strong = (F.size("hard_fails") == 0) & (F.col("source") == "dart_struct") & (F.col("top1") >= STRONG) & ~F.array_contains("soft_flags", F.lit("R3_source_missing"))
    failed = (F.size("hard_fails") > 0) | ((F.size("soft_flags") > 1) & ~F.coalesce(strong, F.lit(False)))
    return rows.withColumn("decision", F.when(~failed, "ACCEPT").otherwise("ESCALATE" if tier < max_tier else "HUMAN"))


def method_overlap(lists: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, overlap): Jaccard of the two methods' k best."""
    ids = lambda kind: F.collect_set(F.when((F.col("kind") == kind) & (F.col("rank") <= k), F.col("doc_id")))
    both = lists.groupBy("query_id").agg(ids("bm25").alias("x"), ids("vector").alias("y"))
    return both.select("query_id", F.coalesce(F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))), F.lit(0.0)).alias("overlap"))


def channels(docs: DataFrame, queries: DataFrame, k: int = 3, tokens: Callable[[Column], Column] = word_pairs) -> DataFrame:
    """(query_id, channel, doc_id, score, rank): the k best of each query in each of its channels by both methods, fused; lists aren't mixed.

    docs has channel, scope, doc_id, text, code and source; queries query_id, text and scopes, a map of channel to the scope it looks into (all
    guidelines, its industry's texts, its own company's). Each (channel, scope) is an index of its own. Queries that ask an index the same are scored
    once. A channel without a hit has no rows, whatever the others find.
    """
    deep, index = max(k, 8), ["channel", "scope"]
    wanted = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), F.explode("scopes").alias("channel", "scope"))
    asked = wanted.select(*index, "text").distinct().select(*index, F.struct(*index, "text").alias("query_id"), "text")
    kept = ("code", "source")
    lists = ranked(scores(docs, asked, index, tokens, kept), deep, kept)
    best = fuse(lists, k, query_bonus(F.col("code"), F.col("source"), F.col("query_id.text"))).select("query_id.*", "doc_id", "score", "rank")
    return wanted.join(best, [*index, "text"]).select("query_id", "channel", "doc_id", "score", "rank")


def cascade(docs: DataFrame, queries: DataFrame, k: int = 5, max_tier: int = 2, tokens: Callable[[Column], Column] = word_pairs) -> DataFrame:
    """(query_id, tier, decision, hard_fails, soft_flags, ids): keywords alone, then both methods, then variants of the
    query fused by rank; the first tier that is accepted, else the last.

    docs has doc_id, text, code, source and report_year, queries query_id, text and area_terms. All tiers are computed
    together, as stopping early would only save work for single queries. Queries that find nothing fail in every tier.
    """
    deep = max(k, 8)
    variants = queries.select("query_id", F.posexplode(query_variants(F.coalesce("text", F.lit("")))).alias("v", "text"))
    keyed = variants.select(F.struct("query_id", "v").alias("query_id"), "text")
    facts = docs.select("doc_id", "code", F.col("source").alias("_source"))
    lists = top_lists(docs.sparkSession, docs.select("doc_id", "text"), keyed, deep, tokens)
    named = lists.select("query_id", "doc_id").distinct().join(facts, "doc_id").join(keyed, "query_id")
    bonus = named.select("query_id", "doc_id", query_bonus(F.col("code"), F.col("_source"), F.col("text")).alias("bonus"))
    plain = lambda rows: rows.withColumn("query_id", F.col("query_id.query_id"))
    own = F.col("query_id.v") == 0
    tier0 = plain(top(lists.where(own & (F.col("kind") == "bm25")).withColumn("score", F.round(min_max("score", "query_id", "kind"), 4)), "score", k)).select("query_id", "doc_id", "score", "rank", F.lit(0).alias("tier"))
    hybrid = fuse(lists, deep, bonus)
    tier1 = plain(hybrid.where(own & (F.col("rank") <= k))).select("query_id", "doc_id", "score", "rank", F.lit(1).alias("tier"))
    first = plain(bonus.where(own)).withColumn("bonus", F.col("bonus") / 10)
    parts = hybrid.select(F.col("query_id.query_id").alias("query_id"), "doc_id", (F.when(own, 1.0).otherwise(LATER) / (RRF + F.col("rank"))).alias("s"))
    summed = parts.groupBy("query_id", "doc_id").agg(F.sum("s").alias("s")).join(first, ["query_id", "doc_id"], "left").withColumn("s", F.round(F.col("s") + F.coalesce("bonus", F.lit(0.0)), 9)).drop("bonus")
    tier2 = top(summed.withColumn("score", F.round(F.col("s") / F.max("s").over(Window.partitionBy("query_id")), 4)), "score", k).select("query_id", "doc_id", "score", "rank", F.lit(2).alias("tier"))
    hits = tier0.unionByName(tier1).unionByName(tier2).where(F.col("tier") <= max_tier).join(docs, "doc_id")
    at = hits.groupBy("query_id", "tier").agg(
        F.min_by(F.struct("text", "source", "report_year", "score"), "rank").alias("first"), F.max_by("score", "rank").alias("tail"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"),
    )
    overlap = plain(method_overlap(lists.where(own)))
    every = queries.select("query_id", F.coalesce("text", F.lit("")).alias("query"), "area_terms", F.explode(F.array(*[F.lit(t) for t in range(max_tier + 1)])).alias("tier"))
    found = every.join(at, ["query_id", "tier"], "left").join(overlap, "query_id", "left")
    found = found.select("query_id", "tier", "query", "area_terms", F.col("first.text").alias("top_text"), "first.source", F.col("first.report_year").cast("string").alias("report_year"), F.col("first.score").alias("top1"), "tail", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("tier") == 0, 0.0).otherwise(F.coalesce("overlap", F.lit(0.0))).alias("overlap"), F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))
    judged = None
    for t in range(max_tier + 1):
        part = gate(found.where(F.col("tier") == t), t, max_tier)
        judged = part if judged is None else judged.unionByName(part)
    best = F.min_by(F.struct("tier", "decision", "hard_fails", "soft_flags", "ids"), F.struct((F.col("decision") != "ACCEPT").alias("late"), F.when(F.col("decision") == "ACCEPT", F.col("tier")).otherwise(-F.col("tier"))))
    return judged.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.*")
