"""A training corpus from raw documents: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row the one before kept; all but the last return the
columns of documents. Texts that a stage changes get a new n_chars, where there is that column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import packing, secretscan, suffixdedup, toxicity
from verdigris.llm.jaccard import jaccard_classes
from verdigris.llm.shared import written

#: Ids are broadcast up to this many rows (8 bytes each); beyond it the texts are shuffled to them.
BROADCAST_ROWS = 1 << 20


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def _by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how).select(*[docs[c] for c in docs.columns])


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the machine is fitted on labelled documents among docs.

    Null and empty texts are scored like texts without telling words and stay; each of repeated rows is judged alike; an
    empty table stays empty. Other columns stay as they are.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, 0.8) the document with the smallest id stays, once.

    Documents without words and without an id stay; of rows that repeat an id one stays. An empty table stays empty.
    """
    classes = written(spark, jaccard_classes(spark, docs, k=5, num=80, den=100), "near-duplicates")
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    repeated = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = _by_ids(docs, written(spark, gone, "gone"), "left_anti")
    repeated = written(spark, repeated, "repeated")
    if not repeated.head(1):
        return kept
    return _by_ids(kept, repeated, "left_anti").unionByName(_by_ids(kept, repeated, "left_semi").dropDuplicates(["doc_id"]))


def repeated_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller id has too are cut; no document is dropped.

    Null and empty texts and rows without an id stay as they are; rows that repeat an id are one document and don't cut
    each other. Parts of characters at a cut go too. An empty table stays empty.
    """
    return _counted(suffixdedup.SuffixDedup(spark, docs, 50).rewritten(docs, "doc_id", "text"))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each run of overlapping secrets becomes <secret>; null, empty and other texts stay, row by row."""
    return _counted(secretscan.mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids: the corpus itself. Null and empty texts are one piece with the end's id; repeated rows
    are packed again; an empty table gives no pieces. The first stages' other columns end here.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("ngram_jaccard", one_of_near_duplicates),
    ("suffix_dedup", repeated_passages_go),
    ("secret_scan", secrets_are_masked),
    ("packing", packed),
]

#: SQL can't express the trained machine nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
