"""Overlap joins, retrieval and extraction against plain Python on small texts."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import claims, extraction, overlap, retrieval, similarity, toplists


@pytest.mark.parametrize("block", [7, 1024])
def test_overlaps(spark, monkeypatch, block):
    """Random words with a few very frequent ones, ties, repeated words, null texts; in several passes and blocks too."""
    monkeypatch.setattr(overlap, "SENTENCES", block)
    monkeypatch.setattr(overlap, "CHUNKS", block)
    rng = random.Random(8)
    words = ["the", "of", "a"] * 12 + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", "  ", "\t", "　"]).join(rng.choices(words, k=n))
    chunks = [(f"c{i:03}", text(rng.randint(0, 25))) for i in range(300)] + [("x1", None), ("x2", "")]
    asked = [(i, text(rng.randint(0, 12))) for i in range(40)] + [(90, None), (91, "nowhere"), (92, "the of a")]
    got = collections.defaultdict(list)
    for r in overlap.top_overlaps(spark.createDataFrame(asked, "sentence_id long, text string"), spark.createDataFrame(chunks, "chunk_id string, text string")).orderBy("rank").collect():
        got[r.sentence_id].append((r.overlap, r.chunk_id))
    for i, t in asked:
        want = sorted(((n, c) for c, x in chunks if (n := len(set((t or "").split()) & set((x or "").split())))), reverse=True)[:3]
        assert got.get(i, []) == want


def test_top_lists(spark, monkeypatch):
    """Against scores over one index; small batches, so that bounds do skip; string ids; queries and documents without terms."""
    for name, value in (("DOCUMENTS", 16), ("PARTS", 100), ("REMEMBERED", 20), ("QUERIES", 7)):
        monkeypatch.setattr(toplists, name, value)
    rng = random.Random(4)
    words = ["la", "le"] * 10 + [f"t{i}" for i in range(80)]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(200)] + [("e", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(20)] + [(50, None), (51, "zzz"), (52, "la la le")], "query_id long, text string")
    got = {tuple(r) for r in toplists.top_lists(spark, docs, asked, 5).collect()}
    one = lambda df: df.withColumn("i", F.lit(1))
    want = {tuple(r) for r in retrieval.ranked(retrieval.scores(one(docs), one(asked), ["i"]), 5).select("query_id", "kind", "doc_id", "score", "rank").collect()}
    assert got == want and want
    assert toplists.top_lists(spark, docs.where("false"), asked, 5).collect() == [] == toplists.top_lists(spark, docs, asked.where("false"), 5).collect()


def test_figures(spark):
    """Order of rules, matches that are no numbers, directors that don't add up, either case."""
    texts = {
        1: "온실가스 1.2.3 tCO2, 총 5,000 TCO2EQ. 전력 사용량 1,500 kWh, 총 에너지 3 TJ", 2: "배출량 추정치 (단위: 만톤(tCO2-eq)) 1,827 그리고 온실가스 5 tCO2", 3: "사외이사 3 인, 사내이사 2명", 4: "사외이사 3 인",
        5: "이사의 수 사외이사 수 변동 5 3 - 사외이사 9인", 6: "이사의 수 사외이사 수 2 9. 이사회는 총 8명, 4인의 사외이사", 7: None, 8: "", 9: "출석률: 97.5% 여성 이사 12.5%, 여성 임원 3명",
    }
    got = collections.defaultdict(dict)
    for r in extraction.filing_figures(spark.createDataFrame(list(texts.items()), "id long, text string")).collect():
        got[r.id][r.code] = (r.value, r.unit)
    assert got == {
        1: {"E-3-1": (5000.0, "tCO2eq"), "E-4-1": (1500.0, "kWh")}, 2: {"E-3-1": (18_270_000.0, "tCO2eq")}, 3: {"G-1-2": (60.0, "%")}, 5: {"G-1-2": (60.0, "%")}, 6: {"G-1-2": (50.0, "%")},
        9: {"G-2-1": (97.5, "%"), "G-1-4": (12.5, "%")},
    }


def test_staff_section(spark):
    """A line of a table of contents is passed over; the section ends at the next one or after 30,000 characters."""
    contents, row = "직원 등의 현황 ------ 120\n직원 등의 현황 다음 ", "합 계 900 - 100 - 1,000 9.5 성별합계 남 1 - 1 - 700 성별합계 여 1 - 1 - 300"
    texts = [(1, contents + "가" * 90 + row), (2, contents + "가" * 90 + "미등기임원 보수" + row), (3, contents + "가" * 30_000 + row), (4, row), (5, None), (6, "직원 등의 현황 123 " + "가" * 90 + row)]
    got = collections.defaultdict(dict)
    for r in extraction.staff_ratios(spark.createDataFrame(texts, "id long, text string")).collect():
        got[r.id][r.code] = r.value
    assert got == {1: {"S-2-2": 90.0, "S-3-1": 30.0}}


def test_similarity(spark):
    """Equal texts have cosine one, texts without a common term none; no chunk means the middle of the axis, no reference a similarity of 0."""
    said = spark.createDataFrame([(1, 0, "a", "재생에너지 사용"), (1, 1, "a", "zz"), (2, 0, "b", "x"), (3, 0, "a", None)], "id long, sentence int, corp string, text string")
    chunks = spark.createDataFrame([("a", "재생에너지 사용"), ("a", "폐기물")], "corp string, text string")
    sims = {(r.id, r.sentence): r.sim for r in similarity.retrieved_similarity(said, chunks, ["corp"], ["id", "sentence"]).collect()}
    assert sims[1, 0] == 1.0 and sims[3, 0] == 0.0 and (2, 0) not in sims
    axis = lambda s: spark.range(1).select(claims.semantic_axis(F.lit(s).cast("double"))).first()[0]
    assert [axis(s) for s in (None, 1.0, 0.35, 0.07, 0.0)] == [0.5, 0.0, 0.0, 0.8, 1.0]
    texts = said.where("sentence = 0").drop("sentence")
    mean = {r.id: r.sim for r in similarity.mean_similarity(texts, chunks.unionByName(chunks), ["corp"]).collect()}
    assert mean[2] == 0.0 and mean[3] == 0.0 and mean[1] >= 0.5
