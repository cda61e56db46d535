"""The best documents of each query by BM25 and by hashed vectors, without a row for each document and query.

Queries are cut into blocks whose terms and vectors fit in a task. The documents are read once for the statistics of these terms, and once to be
scored: a batch of documents is a block of postings with the largest part that each term has in it, so queries whose sum of such parts stays below
their k-th score so far are skipped for the whole batch; only the others are scored. What leaves a task is its best k of each query and kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.measures import words

# Parameters of BM25, and buckets of a hashed vector.
K1, B, BUCKETS = 1.5, 0.75, 256
#: Queries that are scored together, documents in a block of postings, and parts of scores that are summed at once.
QUERIES, DOCUMENTS, PARTS = 1024, 512, 1 << 19
#: Terms whose bucket a task remembers.
REMEMBERED = 1 << 17


class _Asked:
    """A block of queries: for each term the queries that have it, and how often; each query's vector."""

    def __init__(self, terms: list[list[str]]):
        self.n = len(terms)
        self.vocabulary = sorted({t for query in terms for t in query})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        flat = np.array([number[t] for query in terms for t in query], dtype=np.int64)
        who = np.repeat(np.arange(self.n), [len(query) for query in terms])
        at, often = np.unique(flat * max(self.n, 1) + who, return_counts=True)
        self.term, self.query, self.often = at // max(self.n, 1), at % max(self.n, 1), often.astype(np.float64)
        self.first = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        buckets = np.array([bucket_of(t) for t in self.vocabulary], dtype=np.int64)
        self.vectors = np.zeros((BUCKETS, self.n))
        np.add.at(self.vectors, (buckets[flat], who), 1.0)
        self.length = np.sqrt((self.vectors**2).sum(axis=0))


def bucket_of(term: str) -> int:
    return hashlib.md5(term.encode()).digest()[-1]


class _Best:
    """The k best documents of each query so far: score downwards, then id upwards."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, [([], []) for _ in range(n)]
        self.bound = np.full(n, 0.0)

    def add(self, query: np.ndarray, score: np.ndarray, ids: list) -> None:
        order = np.argsort(query, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], query[order][1:] != query[order][:-1], [True]))) if len(query) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            q, rows = int(query[order[a]]), order[a:b]
            if b - a > self.k:  # all that may be among the k best, with those that are equal
                rows = rows[score[rows] >= np.partition(score[rows], -self.k)[-self.k]]
            both = sorted(zip((-score[rows]).tolist(), [ids[i] for i in rows.tolist()])) if not self.held[q][0] else sorted([*zip(*self.held[q]), *zip((-score[rows]).tolist(), [ids[i] for i in rows.tolist()])])
            self.held[q] = tuple(map(list, zip(*both[: self.k])))
            if len(both) >= self.k:
                self.bound[q] = -self.held[q][0][-1]


def _scorer(asked: _Asked, idf: np.ndarray, average: float, k: int, kind: pa.DataType):
    vocabulary = pa.array(asked.vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {"bm25": _Best(asked.n, k), "vector": _Best(asked.n, k)}
        remembered: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                lists = part.column(1)
                ids, n, terms = part.column(0).to_pylist(), np.diff(lists.offsets.to_numpy()), lists.flatten()
                if not len(terms):
                    continue
                row = np.repeat(np.arange(len(part)), n)
                found = terms.dictionary_encode()
                names = found.dictionary.to_pylist()
                if len(remembered) + len(names) > REMEMBERED:
                    remembered.clear()
                for t in names:
                    if t not in remembered:
                        remembered[t] = bucket_of(t)
                code = found.indices.to_numpy()
                buckets = np.fromiter((remembered[t] for t in names), np.int64, len(names))[code]
                vectors = np.bincount(row * BUCKETS + buckets, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS).astype(np.float64)
                norm = np.sqrt((vectors**2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.round(vectors @ asked.vectors / norm[:, None] / asked.length[None, :], 6)
                doc, query = np.nonzero(np.nan_to_num(cosine) >= np.maximum(best["vector"].bound, 1e-6)[None, :])
                best["vector"].add(query, cosine[doc, query], [ids[i] for i in doc.tolist()])

                place = pc.fill_null(pc.index_in(found.dictionary, value_set=vocabulary), -1).to_numpy().astype(np.int64)[code]
                known = place >= 0
                pair, tf = np.unique(row[known] * max(len(vocabulary), 1) + place[known], return_counts=True)
                doc, term = pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1)
                length = np.maximum(n[doc], 1) / max(average, 1.0)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
                most = np.zeros(len(vocabulary))
                np.maximum.at(most, term, weight)
                bound = best["bm25"].bound
                open_ = np.bincount(asked.query, weights=most[asked.term] * asked.often, minlength=asked.n) >= bound - 1e-6
                many = asked.first[term + 1] - asked.first[term]
                upto = np.cumsum(many)
                cuts = np.unique(np.searchsorted(doc, doc[np.searchsorted(upto, np.arange(PARTS, int(upto[-1]) if len(upto) else 0, PARTS))])).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(doc)]):
                    if a == b:
                        continue
                    entry = np.repeat(np.arange(a, b), many[a:b])
                    to = np.arange(len(entry)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + asked.first[term[entry]]
                    going = open_[asked.query[to]]
                    entry, to = entry[going], to[going]
                    where, inverse = np.unique((doc[entry] - doc[a]) * asked.n + asked.query[to], return_inverse=True)
                    score = np.round(np.bincount(inverse, weights=weight[entry] * asked.often[to]), 6)
                    good = (score > 0) & (score >= bound[where % max(asked.n, 1)])
                    best["bm25"].add(where[good] % asked.n, score[good], [ids[i] for i in (where[good] // asked.n + doc[a]).tolist()])
        out = [(q, name, i, -s) for name, x in best.items() for q, (scores, found) in enumerate(x.held) for s, i in zip(scores, found)]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], kind), pa.array(columns[3], pa.float64())], names=["q", "kind", "doc_id", "score"])

    return run


def top_lists(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """(query_id, kind, doc_id, score, rank): the k best of each query by keywords (kind bm25) and by vectors, of scores above 0.

    docs has doc_id (a whole number or a string) and text, queries query_id and text; a term that a query repeats counts each time, ties go to the smaller
    doc_id, scores have six digits. Null and empty texts match nothing. Exact: what is skipped can't be among the best. A pass over the documents serves
    1,024 queries; their terms, at most so many texts, and the statistics of these terms are what the driver holds.
    """
    made = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    asked = queries.select("query_id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    total, average = made.agg(F.count(F.lit(1)), F.avg(F.size("w").cast("double"))).first()
    blocks = -(-asked.count() // QUERIES)
    # An Arrow batch holds the terms of all its texts on both sides: this session's have no more rows than a block from now on.
    rows_key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows_key)) <= DOCUMENTS:
        spark.conf.set(rows_key, DOCUMENTS)
    id_type = made.schema["doc_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = mine.collect()
        held = _Asked([r.w for r in rows])
        vocabulary = spark.createDataFrame([(t,) for t in held.vocabulary], "term string")
        df = dict(made.select(F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").count().collect())
        at = np.array([df.get(t, 0) for t in held.vocabulary], dtype=np.float64)
        idf = np.log(1 + (total - at + 0.5) / (at + 0.5))
        found = made.mapInArrow(_scorer(held, idf, average or 0.0, k, kind), f"q int, kind string, doc_id {id_type}, score double")
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], StructType([StructField("q", IntegerType()), mine.schema["query_id"]]))
        order = Window.partitionBy("q", "kind").orderBy(F.desc("score"), "doc_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("query_id", "kind", "doc_id", "score", "rank")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = asked.where("false").select("query_id", F.lit("").alias("kind"), F.lit(None).cast(id_type).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return out
