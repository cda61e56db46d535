"""Sentences joined with the chunks and items that share words with them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Blank characters of Unicode, which part words.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Sentences that a pass over the chunks serves, and chunks that are counted together.
SENTENCES, CHUNKS = 1024, 512


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != ""))


def _best_of(asked: list[list[str]], k: int):
    """Scores batches of chunks (id, words) against sentences, given as lists of different words."""
    vocabulary = sorted({w for words in asked for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    names = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros((len(vocabulary), len(asked)), dtype=np.float32)
        for i, words in enumerate(asked):
            has[[number[w] for w in words], i] = 1
        held: list[list[tuple[int, str]]] = [[] for _ in asked]
        bound = np.ones(len(asked), dtype=np.float32)
        for batch in batches:
            for at in range(0, len(batch), CHUNKS):
                part = batch.slice(at, CHUNKS)
                lists = part.column(1)
                code = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy()
                row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))[code >= 0]
                there, column = np.unique(code[code >= 0], return_inverse=True)
                mine = has[there]
                # A sentence can't find anything better here than all of its words that occur here.
                open_ = np.flatnonzero(mine.sum(axis=0) >= bound) if len(there) else []
                if not len(open_):
                    continue
                held_here = np.zeros((len(part), len(there)), dtype=np.float32)
                held_here[row, column] = 1
                shared = held_here @ mine[:, open_]
                rows, which = np.nonzero(shared >= bound[open_][None, :])
                ids, found = part.column(0).to_pylist(), {}
                for r, q in zip(rows.tolist(), which.tolist()):
                    found.setdefault(int(open_[q]), []).append((int(shared[r, q]), ids[r]))
                for q, more in found.items():
                    held[q] = heapq.nlargest(k, held[q] + more)
                    if len(held[q]) == k:
                        bound[q] = held[q][-1][0]
        rows_out = [(q, i, n) for q, found in enumerate(held) for n, i in found]
        columns = list(zip(*rows_out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["q", "chunk_id", "overlap"])

    return run


def top_overlaps(sentences: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(sentence_id, chunk_id, overlap, rank): of each sentence the k chunks that share most words, ties to the larger chunk_id (a string).

    Exact, and without a row or an exchange for pairs that share a word: a pass over the chunks serves 1,024 sentences, whose words go to the
    tasks. A block of chunks is skipped for sentences that have fewer words in it than their k-th overlap so far, others are counted at once
    as a product of two small matrices; a task hands on its k best. Null and empty texts, and sentences that share no word, have no rows.
    """
    spark = sentences.sparkSession
    asked = sentences.select("sentence_id", word_set(F.col("text")).alias("w"))
    held = chunks.select("chunk_id", word_set(F.col("text")).alias("w")).where("size(w) > 0")
    blocks = max(1, -(-asked.count() // SENTENCES))
    out = None
    for block in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("sentence_id"), F.lit(blocks)) == block) if blocks > 1 else asked).collect()
        found = held.mapInArrow(_best_of([r.w for r in rows], k), "q int, chunk_id string, overlap int")
        names = spark.createDataFrame([(i, r.sentence_id) for i, r in enumerate(rows)], StructType([StructField("q", IntegerType()), asked.schema["sentence_id"]]))
        order = Window.partitionBy("q").orderBy(F.desc("overlap"), F.desc("chunk_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("sentence_id", "chunk_id", "overlap", "rank")
        out = best if out is None else out.unionByName(best)
    return out


def _items(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with its items in their order: a taxonomy's, so an array of bounded length."""
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "code", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("note", F.lit("")).alias("note")))).alias("_items"))


def likeliest_items(sentences: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """sentences (keys, text) with code: of its key's items (keys, ord, code, name, note) the one of whose name's and note's words, repeats
    counted, the text contains most; the first of equals, null where it contains none. One join by key, no row for each sentence and item.
    """
    def hits(x: Column) -> Column:
        return F.size(F.filter(F.concat(F.split(x["name"], BLANK), F.split(x["note"], BLANK)), lambda w: (w != "") & F.contains(F.col("text"), w)))

    best = F.array_min(F.transform("_items", lambda x: F.struct((-hits(x)).alias("n"), x["ord"].alias("ord"), x["code"].alias("code"))))
    met = sentences.join(_items(items, keys), keys, "left").withColumn("_best", best)
    return met.withColumn("code", F.when(F.col("_best.n") < 0, F.col("_best.code"))).drop("_items", "_best")


def named_items(sentences: DataFrame, items: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """sentences with codes: the first `most` items of their key whose whole name or note the text contains."""
    named = F.filter("_items", lambda x: ((x["note"] != "") & F.contains(F.col("text"), x["note"])) | ((x["name"] != "") & F.contains(F.col("text"), x["name"])))
    met = sentences.join(_items(items, keys), keys, "left")
    return met.withColumn("codes", F.coalesce(F.transform(F.slice(named, 1, most), lambda x: x["code"]), F.array().cast("array<string>"))).drop("_items")


def item_nodes(items: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, node_ids): for each item (keys, code, keywords) the evidence (keys, node_id, metric, raw_text, unit, ord) whose metric
    is a keyword, or that has a keyword in its metric, text or unit, in the order of ord. Items that find none have an empty list.

    The keywords are met within a key only (a company and year), and pairs that don't match are dropped in the join.
    """
    hay = F.concat_ws(" ", F.col("_n.metric"), F.coalesce(F.col("_n.raw_text"), F.lit("")), F.coalesce(F.col("_n.unit"), F.lit("")))
    held = nodes.select(*keys, F.struct("node_id", "metric", "raw_text", "unit", "ord").alias("_n"))
    same = [items[k].eqNullSafe(held[k]) for k in keys]
    match = F.array_contains(items["keywords"], F.col("_n.metric")) | F.exists(items["keywords"], lambda w: F.contains(hay, w))
    condition = match
    for test in same:
        condition = condition & test
    met = items.join(held, condition, "left").select(*[items[k] for k in keys], items["code"], F.when(F.col("_n").isNotNull(), F.struct(F.col("_n.ord"), F.col("_n.node_id"))).alias("_n"))
    return met.groupBy(*keys, "code").agg(F.transform(F.array_sort(F.collect_list("_n")), lambda x: x["node_id"]).alias("node_ids"))
