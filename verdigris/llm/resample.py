"""Importance resampling towards a target distribution: hashed n-grams of words, weights, and a global draw.

Texts up to `chunk_bytes` are read where they lie. Longer ones are split at word boundaries into chunks that go to
tasks of their own: a chunk owns the words that start in it and carries the n - 1 words that follow, so each n-gram
is counted once, by the chunk in which it starts. Counts are summed over chunks by bucket, weights by document.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, words
from .shared import scratch_path, small_batches, written

#: Bytes that end words: all of ASCII but digits and letters.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
BOUNDARY = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Words up to so many bytes are moved along a checksum by table, longer ones by powers of two.
TABLED = 64


@dataclass(frozen=True)
class ResampleParams:
    """longest: words in the longest run; buckets: features share these by crc32; percent: of the texts with at least
    least_words words, so many in a hundred are drawn; chunk_bytes: longer texts are dealt out in chunks."""

    longest: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: str = "42"
    chunk_bytes: int = 1 << 16


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


BYTE = _byte_table()


def _lanes(steps: int) -> np.ndarray:
    """(steps + 1, 4, 256): what each byte of a checksum becomes when 0, 1, ... zero bytes follow."""
    out = np.zeros((steps + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(steps):
        out[n + 1] = BYTE[out[n] & 255] ^ (out[n] >> 8)
    return out


def _applied(lanes: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return lanes[0][crc & 255] ^ lanes[1][(crc >> 8) & 255] ^ lanes[2][(crc >> 16) & 255] ^ lanes[3][crc >> 24]


LANES = _lanes(TABLED + 1)
FLAT = LANES.reshape(-1)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they stand when n zero bytes follow: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    at = np.minimum(n, TABLED + 1).astype(np.int64) << 10
    out = FLAT[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= FLAT[at + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    far = np.flatnonzero(n > TABLED + 1)
    if len(far):
        left, moved, lanes = n[far].astype(np.int64), crc[far], LANES[1]
        while left.any():
            moved = np.where(left & 1, _applied(lanes, moved), moved)
            left >>= 1
            lanes = _applied(lanes, lanes)
        out[far] = moved
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word: a byte of all words at a time, long words by zlib."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, TABLED + 1).astype(np.int16), kind="stable")
    at, left = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    long = int((left > TABLED).sum())
    n = len(order)
    for step in range(int(left[long]) if long < n else 0):
        n = long + int(np.searchsorted(-left[long:n], -step, side="left"))
        s = state[long:n]
        state[long:n] = BYTE[(s ^ data[at[long:n] + step]) & 255] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + left[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, owned: np.ndarray, p: ResampleParams) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each row, (rows, buckets) of the runs of 1, 2, ... words) that start in the first `owned` bytes of a row."""
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, OUTSIDE)
    lengths, crc = ends - starts, word_checksums(data, starts, ends)
    mine = starts - offsets[rows] < owned[rows]
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), lengths) ^ crc
    run, out = crc, []
    for g in range(p.longest):
        if g:
            run = shifted(run[:-1], lengths[g:] + 1) ^ spaced[g:]
        whole = (rows[: len(run)] == rows[g:]) & mine[: len(run)]
        out.append((rows[: len(run)][whole], (run[whole] % np.uint32(p.buckets)).astype(np.int64)))
    return np.bincount(rows[mine], minlength=len(offsets) - 1), out


def text_chunks(text: bytes, size: int, carry: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, bytes owned, piece): pieces begin where the one before owns no more, at a word's end, and hold
    `carry` words beyond what they own. A word longer than size lies whole in one piece."""
    following = re.compile(rb"(?:[^0-9A-Za-z\x80-\xff]*[0-9A-Za-z\x80-\xff]+){0,%d}" % carry)
    at = number = 0
    while at < len(text) or not number:
        found = BOUNDARY.search(text, at + size)
        cut = found.start() if found else len(text)
        yield number, cut - at, text[at : following.match(text, cut).end()]
        at, number = cut, number + 1


class Resampler:
    """Counts and weights of one table's texts. Both read the texts once for short ones and once for long ones."""

    def __init__(self, spark: SparkSession, p: ResampleParams):
        self.spark, self.p = spark, p

    def _pieces(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, owned, piece) of short texts, whole, and (id, key, owned, piece) of the chunks of long ones, dealt out."""
        p = self.p
        short = docs.where(F.octet_length("text") <= p.chunk_bytes).select("id", F.octet_length("text").cast("long").alias("owned"), F.col("text").cast("binary").alias("piece"))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    text = batch.column(1)[i].as_py()
                    key = hashlib.sha256(text).digest()
                    for number, owned, piece in text_chunks(text, p.chunk_bytes, p.longest - 1):
                        yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([key], pa.binary()), pa.array([number], pa.int64()), pa.array([owned], pa.int64()), pa.array([piece], pa.binary())], names=["id", "key", "number", "owned", "piece"])

        long = docs.where(F.octet_length("text") > p.chunk_bytes).select("id", F.col("text").cast("binary").alias("text"))
        long = long.mapInArrow(split, "id long, key binary, number long, owned long, piece binary").repartition("key", "number")
        return short, long

    def counts(self, docs: DataFrame) -> np.ndarray:
        """Features in each bucket over all texts: a row a bucket and task is summed by Spark, a row a bucket reaches the driver."""
        p = self.p

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p.buckets, dtype=np.int64)
            for batch in batches:
                owned = batch.column(0).to_numpy()
                for lo, hi, data, offsets in chunks(batch.column(1)):
                    for _, found in feature_buckets(data, offsets, owned[lo:hi], p)[1]:
                        total += np.bincount(found, minlength=p.buckets)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

        found = [x.select("owned", "piece").mapInArrow(count, "bucket long, n long") for x in self._pieces(docs)]
        out = np.zeros(p.buckets, dtype=np.int64)
        for r in found[0].unionByName(found[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] = r.n
        return out

    def weights(self, docs: DataFrame, gains: np.ndarray) -> DataFrame:
        """(id, n_words, n_features, weight), a row a row."""
        p = self.p

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                owned = batch.column(names.index("owned")).to_numpy()
                for lo, hi, data, offsets in chunks(batch.column(names.index("piece"))):
                    n_words, found = feature_buckets(data, offsets, owned[lo:hi], p)
                    n, weight = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                    for rows, buckets in found:
                        upto = np.searchsorted(rows, np.arange(hi - lo + 1))
                        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(gains[buckets])))
                        n += np.diff(upto)
                        weight += np.diff(sums[upto])
                    kept = [batch.column(i)[lo:hi] for i, c in enumerate(names) if c not in ("owned", "piece")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(n), pa.array(weight)], names=[*(c for c in names if c not in ("owned", "piece")), "n_words", "n_features", "weight"])

        short, long = self._pieces(docs)
        told = "n_words long, n_features long, weight long"
        parts = long.mapInArrow(weigh, f"id long, key binary, number long, {told}")
        # Rows that repeat have equal chunks: their sums are divided by the number of first chunks, and put out as often.
        copies = F.sum(F.when(F.col("number") == 0, 1).otherwise(0))
        whole = parts.groupBy("id", "key").agg(copies.alias("copies"), *[F.expr(f"sum({c}) div sum(if(number = 0, 1, 0))").alias(c) for c in ("n_words", "n_features", "weight")])
        whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return short.mapInArrow(weigh, f"id long, {told}").unionByName(whole.select("id", "n_words", "n_features", "weight"))


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the raw one's), of each bucket, in doubles."""
    k, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def noise(id: Column, seed: str) -> Column:
    """Thousandths of Gumbel noise from the id: floor(-1000 ln(-ln((h + 0.5) / 2 ** 32))), h of its sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_ranks(spark: SparkSession, rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (no column named __at) with rank: 1, 2, ... over all of them. One exchange by ranges, sorted and written; only the sizes of
    its partitions reach the driver, and a row's rank is its place in its partition plus the sizes of those before.
    """
    path = scratch_path(spark, "ranked")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part, before, sums = F.shiftright("__at", 33), 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        sums.append((r.part, before))
        before += r["count"]
    sizes = spark.createDataFrame(sums, "__part long, __before long")
    placed = placed.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return placed.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def importance_resample(spark: SparkSession, docs: DataFrame, target: DataFrame, p: ResampleParams = ResampleParams(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank is null for those that aren't drawn.

    Words are lower-cased in A-Z and cut at all of ASCII but letters and digits. Null and empty texts have no feature and weight 0. Of
    the n texts with at least least_words words, floor(percent n / 100) are drawn by score, ties to the smaller id. Rows
    that repeat an id are drawn on their own, with equal noise; a row without an id has no score and is not drawn. An
    empty target weighs features by rarity alone; an empty table gives an empty one. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("text"))
    job = Resampler(spark, p)
    with small_batches(spark):
        gains = bucket_gains(job.counts(texts), job.counts(wanted))
        weighed = written(spark, job.weights(texts, gains).withColumn("score", F.col("weight") + noise(F.col("id"), p.seed)), "weights")
    enough = (F.col("n_words") >= p.least_words) & F.col("id").isNotNull()
    drawn = p.percent * weighed.where(enough).count() // 100
    ranked = with_ranks(spark, weighed.where(enough), [F.col("score").desc(), F.col("id").asc()])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(weighed.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
