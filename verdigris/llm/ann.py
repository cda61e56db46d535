"""Approximate nearest neighbours by multiprobe cross-polytope hashing with exact reranking in blocks.

A table hashes a vector by several pseudo-rotations, each to its nearest signed axis. The leading axes deal vectors
and queries out to tasks, so many that a task has about block_vectors vectors; the axis after them is told apart
inside a task. More vectors thus have more rotations, and buckets shrink as the corpus grows, but not below
BUCKET_VECTORS: a task compares a bucket with all queries that look into it at once, and that needs vectors in it.

Queries go to the buckets about their own leading axis first. The k-th best score of a query there is a floor for the
others, from which only what reaches it comes back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Counts of buckets are broadcast up to this many rows (16 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1 << 20
#: Vectors a bucket should have on average, before another rotation cuts it.
BUCKET_VECTORS = 16
#: A task takes up to so many blocks of vectors, and of queries, so that fewer copies of either are dealt out.
VECTOR_BLOCKS, QUERY_BLOCKS = 4, 16
#: Scores compared at once, and scores kept before the k best of each query are told.
SCORES, KEPT = 1 << 20, 1 << 18


@dataclass(frozen=True)
class CrossPolytope:
    """tables hash tables; a vector is stored in one bucket of each, a query looks into the `probes` buckets nearest
    to it, 16 times as many for each rotation above two. A query that meets fewer than `least` vectors in all tables
    together is compared with every vector instead, so none lacks neighbours. On the given, nearly random vectors,
    the hardest case, recall at 20 is measured in tests and README.
    """

    tables: int = 8
    probes: int = 512
    least: int = 2000
    seed: int = 20_240_607
    block_vectors: int = 4096
    block_queries: int = 1024


def pseudo_rotations(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; columns padded to a power of two."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = x * rng.choice(np.array([-1.0, 1.0]), n)
        h = 1
        while h < n:
            pairs = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
    return x


def signed_axes(x: np.ndarray, table: int, rotations: int, seed: int) -> np.ndarray:
    """(row, rotation, signed axis): how far each row points along each of the 2n signed axes."""
    turned = np.stack([pseudo_rotations(x, table * 64 + r, seed) for r in range(rotations)], axis=1)
    return np.concatenate([turned, -turned], axis=2)


def probe_codes(along: np.ndarray, probes: int) -> np.ndarray:
    """Codes of the buckets nearest to one query: least sum of squared gaps to its own axis over the rotations."""
    rotations, axes = along.shape
    width = min(axes, max(2, math.ceil((5.0 * probes) ** (1 / rotations))))
    codes, gaps = np.zeros(1, np.int64), np.zeros(1)
    for r in range(rotations):
        near = np.argsort(-along[r], kind="stable")[:width]
        codes = (codes[:, None] * axes + near).ravel()
        gaps = (gaps[:, None] + (along[r, near[0]] - along[r, near]) ** 2).ravel()
    return codes[np.argsort(gaps, kind="stable")[:probes]]


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double precision) for each length of vectors that aren't null, empty or all zero and whose
    components are all finite.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if fine.any():
            yield rows[fine], x[fine]


def _inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so equal vectors give equal scores."""
    total = np.zeros(len(v))
    for d in range(q.shape[0]):
        total += q[d] * v[:, d]
    return total


def _best(q: np.ndarray, q_id: int, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best vectors for one query, its own id left out and repeated ids counted once."""
    rough = v @ q
    rough[ids == q_id] = -np.inf
    at = rough.argpartition(-2 * k)[-2 * k :] if len(v) > 2 * k else np.arange(len(v))
    slack = 1e-9 * (1 + np.abs(q).max() * np.abs(v).max() * len(q))
    at = np.flatnonzero(rough >= max(np.sort(rough[at])[-k:].min() - slack, np.finfo(float).min))
    exact = _inner(q, v[at])
    best = np.lexsort((ids[at], -exact))
    _, first = np.unique(ids[at][best], return_index=True)
    if len(first) < k and len(at) < len(v):  # repeated ids took the places: look at all
        exact, at = _inner(q, v[ids != q_id]), np.flatnonzero(ids != q_id)
        best = np.lexsort((ids[at], -exact))
        _, first = np.unique(ids[at][best], return_index=True)
    best = best[np.sort(first)][:k]
    return ids[at][best], exact[best]


def leading(n: int, axes: int, params: CrossPolytope) -> int:
    """Rotations that deal n vectors out: blocks of block_vectors, unless buckets would be nearly empty then."""
    wanted = math.ceil(math.log(max(1, n / params.block_vectors), axes))
    return max(1, min(wanted, math.floor(math.log(max(1, n / BUCKET_VECTORS), axes)) - 1))


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """_inner of each row of q with the same row of v."""
    return np.concatenate([np.cumsum(q[lo : lo + 4096] * v[lo : lo + 4096], axis=1)[:, -1] + 0.0 for lo in range(0, len(q), 4096)]) if len(q) else np.zeros(0)


def best_in_buckets(q: np.ndarray, q_ids: np.ndarray, wanted: list[np.ndarray], v: np.ndarray, ids: np.ndarray, codes: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores) of up to the k best vectors of the buckets each query wants that reach its floor, its own id left out, and how
    many vectors each query met. Vectors stand in the order of codes. A bucket is multiplied with all its queries at once; a query's floor rises with what it has.
    """
    of, code = np.repeat(np.arange(len(q)), [len(w) for w in wanted]), np.concatenate(wanted)
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    held, begin = np.unique(codes, return_index=True)
    end = np.append(begin[1:], len(codes))
    at = np.searchsorted(held, code)
    there = held[np.minimum(at, len(held) - 1)] == code
    met = np.bincount(of[there], (end - begin)[at[there]], minlength=len(q)).astype(np.int64)
    scale = np.abs(v).max() * q.shape[1]
    slack = 1e-9 * (1 + np.abs(q).max(axis=1) * scale)
    if len(np.unique(ids)) < len(ids) or not np.isfinite(slack * 1e9).all():  # repeated ids or scores beyond doubles: one query at a time
        rows, found, scores = [], [], []
        for i in range(len(q)):
            mine = np.isin(codes, wanted[i]) & (ids != q_ids[i])
            met[i] = mine.sum()
            if met[i]:
                best, score = _best(q[i], q_ids[i], v[mine], ids[mine], k)
                rows.append(np.full(len(best), i)), found.append(best), scores.append(score)
        return (*(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (found, np.int64), (scores, np.float64))), met)

    by_id = np.argsort(ids)
    own = by_id[np.minimum(np.searchsorted(ids, q_ids, sorter=by_id), len(ids) - 1)]
    mine = ids[own] == q_ids
    met -= mine & np.array([codes[o] in w for o, w in zip(own, wanted)])
    floor, kept, n = floor.copy(), [], 0

    def best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query; its floor is the last of them."""
        order = np.lexsort((ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        floor[rows[rank == k - 1]] = np.maximum(floor[rows[rank == k - 1]], scores[rank == k - 1])
        return rows[rank < k], cols[rank < k], scores[rank < k]

    def told(new: list[tuple[np.ndarray, np.ndarray]], old: tuple) -> tuple:
        rows, cols = (np.concatenate(x) for x in zip(*new))
        other = ids[cols] != q_ids[rows]
        rows, cols = rows[other], cols[other]
        scores = np.concatenate([_exact(q[rows[lo : lo + 4096]], v[cols[lo : lo + 4096]]) for lo in range(0, len(rows), 4096)] or [np.zeros(0)])
        reach = scores >= floor[rows]
        return best(*(np.concatenate((x, y[reach])) for x, y in zip(old, (rows, cols, scores))))

    result = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    starts, stops = np.searchsorted(code, held), np.searchsorted(code, held, side="right")
    for b, e, lo, hi in zip(begin.tolist(), end.tolist(), starts.tolist(), stops.tolist()):
        step = max(1, SCORES // (e - b))
        for cut in range(lo, hi, step):
            asks = of[cut : min(hi, cut + step)]
            rows, cols = np.nonzero(q[asks] @ v[b:e].T >= (floor - slack)[asks][:, None])
            kept.append((asks[rows], cols + b))
            n += len(rows)
            if n >= KEPT:
                result, kept, n = told(kept, result), [], 0
    rows, cols, scores = told(kept, result) if kept else result
    return rows, ids[cols], scores, met


def _matrix(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64)


def _table(found: list[tuple[int, np.ndarray, np.ndarray, int]]) -> pd.DataFrame:
    """Rows of results; how many vectors a query met stands at its first row."""
    out = {
        "query_id": np.concatenate([np.full(len(ids), q) for q, ids, _, _ in found]) if found else np.zeros(0, np.int64),
        "id": np.concatenate([ids for _, ids, _, _ in found]) if found else np.zeros(0, np.int64),
        "score": np.concatenate([s for _, _, s, _ in found]) if found else np.zeros(0),
        "met": np.concatenate([[n] + [0] * (len(ids) - 1) for _, ids, _, n in found]) if found else np.zeros(0, np.int64),
    }
    return pd.DataFrame(out)


def _found(q_ids: np.ndarray | None = None, rows: np.ndarray | None = None, ids: np.ndarray | None = None, scores: np.ndarray | None = None, met: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of results; how many vectors a query met stands in a row with its own id."""
    if q_ids is None:
        return _table([])
    of = np.flatnonzero(met)
    none = np.zeros(len(rows), np.int64)
    return pd.DataFrame({"query_id": np.concatenate((q_ids[rows], q_ids[of])), "id": np.concatenate((ids, q_ids[of])), "score": np.concatenate((scores, np.zeros(len(of)))), "met": np.concatenate((none, met[of]))})


RESULT = "query_id long, id long, score double, met long"


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", params: CrossPolytope = CrossPolytope()) -> DataFrame:
    """The k rows of largest inner product found for each query row (all rows, if there are fewer), its own id left out.

    Returns query_id, rank (from 1), the id and score (double precision, on the vectors as given). Ties go to
    the smaller id. Hashing uses directions only; scores use the vectors themselves. Rows of null id or unusable
    vector take no part; the id is a key, so rows that repeat an id and vector count once. Vectors of different
    lengths have no inner product: a query meets those of its own length. Other columns are left out, whatever
    they are called. An empty table has no result.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id IS NOT NULL")
    n = rows.count()
    rows = rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-n // (2 * params.block_vectors))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for at, x in usable(batch.column(1)):
                axes = 2 << max(0, (x.shape[1] - 1).bit_length())
                lead = leading(n, axes, params)
                probes = params.probes * 16 ** (lead - 1)
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                for lo in range(0, len(x), 2048):
                    here, blobs = at[lo : lo + 2048], [r.tobytes() for r in x[lo : lo + 2048].astype(kind)]
                    for t in range(params.tables):
                        along = signed_axes(unit[lo : lo + 2048], t, lead + 1, params.seed)
                        own = along.argmax(axis=2)
                        code = np.zeros(len(here), dtype=np.int64)
                        for r in range(lead):
                            code = code * axes + own[:, r]
                        last = [c.tobytes() for c in own[:, lead].astype("<u4").reshape(-1, 1)]
                        yield _batch(x.shape[1], t, code, 0, ids[here], last, blobs)
                        leads, lasts, of, far = [], [], [], []
                        for i in np.flatnonzero(asks[here]).tolist():
                            found = np.sort(probe_codes(along[i], probes))
                            first = np.flatnonzero(np.concatenate(([True], found[1:] // axes != found[:-1] // axes)))
                            leads.append(found[first] // axes)
                            lasts += [p.astype("<u4").tobytes() for p in np.split(found % axes, first[1:])]
                            of += [i] * len(first)
                            far.append(leads[-1] != code[i])
                        if of:
                            yield _batch(x.shape[1], t, np.concatenate(leads), 1 + np.concatenate(far), ids[here][of], lasts, [blobs[i] for i in of])

    hashes = written(spark, rows.mapInArrow(hashed, "dim int, tab int, lead long, role int, id long, last binary, v binary"), "ann-hashes")
    least = max(params.least, params.tables * k)

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["role"].to_numpy() > 0
        if not asks.any() or asks.all():
            return _found()
        ids, last, blobs, q = pdf["id"].to_numpy(), pdf["last"].to_numpy(), pdf["v"].to_numpy(), pdf[asks]
        codes = np.frombuffer(b"".join(last[~asks]), dtype="<u4")
        order = np.argsort(codes, kind="stable")
        wanted = [np.frombuffer(w, dtype="<u4") for w in last[asks]]
        rows, found, scores, met = best_in_buckets(_matrix(blobs[asks], kind), ids[asks], wanted, _matrix(blobs[~asks][order], kind), ids[~asks][order], codes[order], q["floor"].to_numpy(), k)
        return _found(ids[asks], rows, found, scores, np.where(q["met"].to_numpy() < least, met, 0))

    def searched(role: int, floors: DataFrame | None = None) -> DataFrame:
        """What the queries of a role find, in the buckets that stand at their leading axes."""
        asking = hashes.where((F.col("role") == 0) | (F.col("role") == role))
        sizes = asking.groupBy("dim", "tab", "lead").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == role).alias("n1")).where("n0 > 0 AND n1 > 0")
        sizes = sizes.select("dim", "tab", "lead", F.ceil(F.col("n0") / (VECTOR_BLOCKS * params.block_vectors)).cast("int").alias("cuts0"), F.ceil(F.col("n1") / (QUERY_BLOCKS * params.block_queries)).cast("int").alias("cuts1"))
        sizes = written(spark, sizes, "ann-sizes")
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
        stored = F.col("role") == 0
        own, others = F.when(stored, F.col("cuts0")).otherwise(F.col("cuts1")), F.when(stored, F.col("cuts1")).otherwise(F.col("cuts0"))
        if floors is None:
            asking = asking.withColumns({"floor": F.lit(float("-inf")), "met": F.lit(0).cast("long")})
        else:
            asking = asking.join(floors, ["role", "id"], "left").withColumns({"floor": F.coalesce("floor", F.lit(float("-inf"))), "met": F.coalesce("met", F.lit(0).cast("long"))})
        dealt = asking.join(sizes, ["dim", "tab", "lead"]).withColumn("own", F.pmod(F.xxhash64("id"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        dealt = dealt.withColumns({"b0": F.when(stored, F.col("own")).otherwise(F.col("other")), "b1": F.when(stored, F.col("other")).otherwise(F.col("own"))}).drop("own", "other", "cuts0", "cuts1")
        return written(spark, dealt.groupBy("dim", "tab", "lead", "b0", "b1").applyInPandas(rerank, RESULT), "ann-found")

    # Those about a query's own leading axes first: how many it met there, and its k-th best score as a floor for the others.
    near = searched(1)
    ranked = near.where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") == k)
    floors = near.groupBy("query_id").agg(F.sum("met").alias("met")).join(ranked.select("query_id", F.col("score").alias("floor")), "query_id", "left")
    floors = written(spark, floors.select(F.lit(2).alias("role"), F.col("query_id").alias("id"), "floor", "met"), "ann-floors")
    far = searched(2, F.broadcast(floors) if floors.count() <= BROADCAST_ROWS else floors)
    found = near.unionByName(far)

    # Queries that met too few are compared with all vectors of their length, in blocks.
    asked = hashes.where("tab = 0 AND role = 0").join(rows.where("is_query").select("id").distinct(), "id", "left_semi").select("id", "dim", "v").distinct()
    enough = found.groupBy("query_id").agg(F.sum("met").alias("met")).where(F.col("met") >= least)
    lacking = written(spark, asked.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"), "ann-lacking")
    blocks = max(1, -(-n // params.block_vectors))
    cuts = max(1, -(-lacking.count() // params.block_queries))
    every = hashes.where("tab = 0 AND role = 0").select("dim", F.lit(0).alias("role"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b0"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("b1"))
    every = every.unionByName(lacking.select("dim", F.lit(1).alias("role"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b0"), F.pmod(F.xxhash64("id"), F.lit(cuts)).cast("int").alias("b1")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, found = pdf["role"].to_numpy() == 1, []
        if asks.any() and not asks.all():
            ids, blobs = pdf["id"].to_numpy(), pdf["v"].to_numpy()
            v, v_ids = _matrix(blobs[~asks], kind), ids[~asks]
            for q, q_id in zip(_matrix(blobs[asks], kind), ids[asks].tolist()):
                if (v_ids != q_id).any():
                    found.append((q_id, *_best(q, q_id, v, v_ids, k), len(v)))
        return _table(found)

    if lacking.head(1):
        found = found.unionByName(written(spark, every.groupBy("dim", "b0", "b1").applyInPandas(compare, RESULT), "ann-exact"))
    best = found.where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)


def _batch(dim: int, tab: int, lead: np.ndarray, role: int | np.ndarray, ids: np.ndarray, last: list[bytes], v: list[bytes]) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, tab), pa.int32()), pa.array(lead, pa.int64()), pa.array(np.full(n, role), pa.int32()), pa.array(ids, pa.int64()), pa.array(last, pa.binary()), pa.array(v, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "tab", "lead", "role", "id", "last", "v"])
