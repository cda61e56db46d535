"""The opN_ queries: each applies its operator to its whole table, and derives the columns wanted."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytebpe, divergence, jaccard, packing, quality, resample, secretscan, simhash, suffixdedup, tokencounts, toxicity, warc

WORD_BPE_END = 49407


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(spark, _table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secretscan.scan_secrets(_table(spark, sf_dir, "documents"))
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(secretscan.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), digest, secretscan.span_text(F.col("spans")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(spark, _table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), WORD_BPE_END).select("doc_id", "n_tokens")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(spark, _table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_secret_scan, op3_warc, op4_byte_bpe, op5_packing, op6_suffix_dedup, op7_quality_rules, op8_toxicity, op9_cross_polytope, op10_token_counts,
    op11_importance_resampling, op12_simhash, op13_source_divergence,
)}
ORACLE_SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS target FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN target <> page_id THEN target END AS refers_to
        FROM t
    """,
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
            FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c
            FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        edges AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
        walk AS (SELECT doc_id AS id, doc_id AS reach FROM s UNION SELECT walk.id, edges.v FROM walk JOIN edges ON walk.reach = edges.u)
        SELECT s.doc_id, any_value(len(sh))::BIGINT AS n_shingles, min(reach) AS component_id FROM s JOIN walk ON walk.id = s.doc_id GROUP BY s.doc_id
    """.replace("\\\\", "\\"),
    "op13_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS ts FROM documents),
        o AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        gr AS (SELECT DISTINCT lang, source FROM d),
        l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        c AS (SELECT g.lang, g.source, k.term, k.n AS nl, coalesce(x.n, 0) AS n
              FROM gr g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x USING (lang, source, term)),
        s AS (SELECT c.*, l.v, l.total, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS mine FROM c JOIN l USING (lang)),
        p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (mine + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (nl + 5)) // (total + 5 * v))::BIGINT AS q FROM s),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
                 FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT u.lang, u.source AS s1, w.source AS s2, sum(abs(u.p - w.p)) AS value FROM p u JOIN p w ON u.lang = w.lang AND u.term = w.term AND u.source <> w.source GROUP BY ALL) x
                 ON x.lang = a.lang AND x.s1 = a.source AND x.s2 = b.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
        b AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM b QUALIFY part = 'pair' OR rank <= 50
    """,
}
