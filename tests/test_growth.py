"""Plans whose work must grow with the rows and not with their pairs, and be dealt out to all cores."""

from verdigris.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_parts_with_equal_words_are_not_paired(spark, tmp_path):
    """60,000 copies in a brand would be 3.6 billion pairs; words in another order and repeated words are the same set."""
    copies = spark.range(60_000).selectExpr("id AS p_partkey", "'A' AS p_brand", "'red bolt' AS p_name")
    rows = [(60_000, "A", "Bolt  red red"), (60_001, "A", "red nut"), (60_002, "A", "blue nut"), (60_003, "A", "tin"), (60_004, "B", "red bolt"), (60_005, "B", " "), (60_006, "B", None), (60_007, "B", "red bolt nut")]
    copies.unionByName(spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string")).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.a: (r.b, r.jaccard) for r in catalogue.QUERIES["word_jaccard_within_brand"](spark, str(tmp_path)).collect()}
    assert len(got) == 60_005 and got[0] == (1, 1.0) and all(got[i] == (0, 1.0) for i in range(1, 60_001))
    third = round(1 / 3, 6)
    assert {a: x for a, x in got.items() if a > 60_000} == {60_001: (0, third), 60_002: (60_001, third), 60_004: (60_007, round(2 / 3, 6)), 60_007: (60_004, round(2 / 3, 6))}


def test_masking_is_dealt_out_by_rows(spark):
    """The customers' file is one small split, but each row brings a long text."""
    assert catalogue.QUERIES["pii_masked_records"](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_table_cells_are_dealt_out_by_rows(spark):
    """A line brings four cells of a few bytes, and each of these many windows."""
    for name in ("table_gate_signals", "tables_restored"):
        assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_values_of_odd_cells(spark):
    """What is kept from the cast is what could not be a number anyway."""
    from pyspark.sql import functions as F

    from verdigris.operators.tables import to_float

    texts = ["1,234", "(5)", "- 7 %", "%-,8", "\x017", " NaN", "inf", "-Infinity", ".5", "+.5e3", "P12", "합계", "", "O1", "((9", "1d", "(", "3-4", "e5"]
    plain = F.regexp_replace(F.regexp_replace("t", r"[%,\s]", ""), r"^[()]+|[()]+$", "").try_cast("double")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_float(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert [(r.t, str(r.got)) for r in rows] == [(r.t, str(r.want)) for r in rows] and sum(r.got is not None for r in rows) >= 10


def test_texts_to_score_go_in_blocks(spark):
    """A task's memory must not hold the terms of 10,000 texts at once."""
    from verdigris.operators import toplists

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10_000)
        docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id % 7, ' other') AS text")
        found = toplists.top_lists(spark, docs, spark.createDataFrame([(1, "word3")], "query_id long, text string"), 2)
        assert [(r.kind, r.doc_id) for r in found.orderBy("kind", "rank").collect() if r.kind == "bm25"] == [("bm25", 3), ("bm25", 10)]
        assert int(spark.conf.get(key)) <= toplists.DOCUMENTS
    finally:
        spark.conf.set(key, before)


def test_channels_read_their_texts_once(spark):
    """Each supplier's texts went through six joins and were made of lineitem again for each."""
    plan = catalogue.QUERIES["three_channel_hits"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3


def test_scores_of_small_indexes(spark):
    """Two queries of an index, repeated terms, a bucket shared without a term, nothing shared, null and empty texts; indexes apart."""
    import collections
    import hashlib
    import math

    from verdigris.operators import retrieval

    at = lambda t: int(hashlib.md5(t.encode()).hexdigest(), 16) % 256
    twin = next(f"w{i}" for i in range(10_000) if at(f"w{i}") == at("red"))
    far = next(f"v{i}" for i in range(10_000) if at(f"v{i}") not in {at("red"), at("nut"), at("tin")})
    docs = [("a", 1, "red nut red"), ("a", 2, twin), ("a", 3, far), ("a", 4, None), ("a", 5, ""), ("a", 6, "nut tin"), ("b", 1, "red tin tin"), ("c", 1, "red")]
    queries = [("a", 1, "red red nut"), ("a", 2, "tin"), ("b", 1, "red tin"), ("b", 2, None), ("d", 1, "red")]
    got = retrieval.scores(spark.createDataFrame(docs, "i string, doc_id int, text string").selectExpr("*", "concat(i, doc_id) AS named"), spark.createDataFrame(queries, "i string, query_id int, text string"), ["i"], kept=("named",)).collect()
    want = {}
    for i, q, asked in queries:
        own = {d: (t or "").split() for x, d, t in docs if x == i}
        for d, w in own.items():
            a, b = collections.Counter(map(at, w)), collections.Counter(map(at, (asked or "").split()))
            if a.keys() & b.keys():
                mean, df = sum(map(len, own.values())) / len(own), lambda t: sum(t in x for x in own.values())  # noqa: B023
                bm25 = sum(math.log(1 + (len(own) - df(t) + 0.5) / (df(t) + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / max(mean, 1))) for t in asked.split())
                want[i, q, d] = (f"{i}{d}", round(bm25, 6), round(sum(n * b[k] for k, n in a.items()) / math.hypot(*a.values()) / math.hypot(*b.values()), 6))
    assert ("a", 1, 2) in want and ("a", 1, 3) not in want and len(got) == len(want)
    for r in got:
        named, bm25, cosine = want[r.i, r.query_id, r.doc_id]
        assert r.named == named and abs(r.bm25 - bm25) < 2e-6 and abs(r.cosine - cosine) < 2e-6
