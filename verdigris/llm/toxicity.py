"""Toxicity: a support vector machine on the gapped subsequence kernel of words, with Nystroem landmarks.

A word's features are its subsequences of two and three letters, each weighted by DECAY to the letters it spans,
so inserted letters weaken a match and don't break it. Runs of single letters are also read as one word, and
characters that are no letters or digits are skipped. Labels belong to texts, so words are instances: those that
mark toxic training texts against those of clean ones. The machine is trained on the Nystroem features of its
landmark words; as these are linear in subsequence weights, one weight per subsequence scores any word. A text's
score is a logistic function of its largest margin and of how many words have a positive one.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SLICE_ROWS, Hasher, chunks, mix, shingle_hashes, words
from .shared import drop, lean, modest_batches, written

DECAY, PAIR_GAP, TRIPLE_SPAN = 0.6, 3, 5
SLOTS = 1 << 20
#: Texts whose smallest three-word shingle is the same under so many hashes are near copies of one another.
FAMILY_MINIMA = 4
#: Letters in a cell; longer words are scored by windows of two cells.
CELL = 12


@dataclass(frozen=True)
class ToxicityParams:
    """train_rows bounds the labelled rows that the machine is fitted on (the first by hash of their id)."""

    train_rows: int = 16_000
    positives: int = 600
    negatives: int = 6000
    landmarks: int = 160
    least_texts: int = 3
    least_share: float = 0.6
    least_evidence: float = 7.0  # log likelihood ratio of a word's count in toxic texts
    inserted: int = 2  # variants with an inserted letter that each bad word is trained with
    penalty: float = 1e-5


def _letters() -> np.ndarray:
    table = np.ones(0x110000, dtype=bool)
    table[:0x10000] = [chr(c).isalnum() for c in range(0x10000)]
    return table


_table: list[np.ndarray] = []


def letters(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the units' letters and digits, and the unit of each."""
    if not _table:
        _table.append(_letters())
    codes = np.frombuffer("\n".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    unit = np.cumsum(codes == 10)
    keep = _table[0][codes]
    codes, unit = codes[keep].astype(np.uint64), unit[keep]
    return codes, unit


def entries(codes: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """(positions, slots, checks, weight) for each way to leave gaps."""
    n = len(codes)
    first = np.concatenate(([True], unit[1:] != unit[:-1])) if n else np.zeros(0, bool)
    lead = codes + first.astype(np.uint64) * np.uint64(1 << 21)  # a word's first letter is its own symbol
    for b in range(1, TRIPLE_SPAN + 1):
        if n <= b:
            return
        same = np.flatnonzero(unit[:-b] == unit[b:])
        for a in [0, *range(1, b)]:
            if not a and b > PAIR_GAP:
                continue
            key = lead[same] * np.uint64(0x9E3779B97F4A7C15) + codes[same + b] * np.uint64(0xC2B2AE3D27D4EB4F)
            if a:
                key = key + codes[same + a] * np.uint64(0x165667B19E3779F9) + np.uint64(1)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield same, (key >> np.uint64(44)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), DECAY ** (b + 1 - (2 if not a else 3))


class WordScorer:
    """Margins of words from one weight per subsequence."""

    def __init__(self, slots: np.ndarray, checks: np.ndarray, weights: np.ndarray, bias: float):
        self.check, self.weight, self.bias = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.float32), bias
        self.check[slots], self.weight[slots] = checks, weights

    def __call__(self, units: list[str]) -> np.ndarray:
        codes, unit = letters(units)
        n_units = len(units)
        if not len(codes):
            return np.full(n_units, self.bias)
        begins = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        at = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
        cell = np.cumsum((at % CELL) == 0) - 1
        n_cells = int(cell[-1]) + 1
        total, norm = np.zeros(n_cells), np.zeros(n_cells)
        for where, slot, check, weight in entries(codes, unit):
            total += np.bincount(cell[where], weights=np.where(self.check[slot] == check, self.weight[slot], 0.0), minlength=n_cells) * weight
            norm += np.bincount(cell[where], minlength=n_cells) * weight**2
        owner = unit[np.flatnonzero((at % CELL) == 0)]
        joined = np.flatnonzero(owner[:-1] == owner[1:])
        pair_total, pair_norm = total.copy(), norm.copy()
        pair_total[joined] += total[joined + 1]
        pair_norm[joined] += norm[joined + 1]
        out = np.full(n_units, -np.inf)
        np.maximum.at(out, owner, pair_total / np.sqrt(np.maximum(pair_norm, 1.0)))
        return np.where(np.isfinite(out), out, 0.0) + self.bias


def kernel_rows(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, slot * 2**32 + check, normalised weight) of every unit's subsequences."""
    codes, unit = letters(units)
    parts = [(unit[w], s.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64), np.full(len(w), x)) for w, s, c, x in entries(codes, unit)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    of, key, value = (np.concatenate(x) for x in zip(*parts))
    norm = np.bincount(of, weights=value**2, minlength=len(units))
    return of, key, value / np.sqrt(np.maximum(norm[of], 1.0))


def dense(units: list[str], columns: np.ndarray) -> np.ndarray:
    of, key, value = kernel_rows(units)
    at = np.minimum(np.searchsorted(columns, key), len(columns) - 1)
    hit = columns[at] == key
    out = np.zeros((len(units), len(columns)), dtype=np.float32)
    np.add.at(out, (of[hit], at[hit]), value[hit])
    return out


def windows(word: str) -> list[str]:
    """The word, or a long one's windows of two cells, a cell apart: words are learnt from as they are scored."""
    return [word] if len(word) <= 2 * CELL else [word[i : i + 2 * CELL] for i in range(0, len(word) - CELL, CELL)]


def train_words(good: list[str], bad: list[str], params: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Subsequence slots, checks and weights, and the bias, of the machine that tells bad words from good ones."""
    rng = np.random.default_rng(11)
    variants = []
    for word in bad:
        for _ in range(params.inserted if len(word) >= 4 else 0):
            at = int(rng.integers(1, len(word)))
            variants.append(word[:at] + chr(int(rng.integers(97, 123))) + word[at:])
    third = params.landmarks // 3
    pool = bad[: 4 * params.landmarks]
    columns = np.unique(kernel_rows(pool + good[:third])[1])
    mapped = dense(pool, columns)
    chosen, far = [0], np.full(len(pool), np.inf)
    while len(chosen) < min(params.landmarks - third, len(pool)):  # farthest first
        last = mapped[chosen[-1]]
        far = np.minimum(far, (mapped**2).sum(1) - 2 * mapped @ last + last @ last)
        chosen.append(int(far.argmax()))
    marks = np.concatenate([mapped[chosen], dense(good[:third], columns)])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    of = np.concatenate([dense(part, columns) @ marks.T @ root for part in (bad + variants, good)])
    x = np.hstack([of, np.ones((len(of), 1))])
    y = np.concatenate([np.ones(len(bad) + len(variants)), -np.ones(len(good))])
    cost = np.where(y > 0, 0.5 / (len(bad) + len(variants)), 0.5 / len(good))
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * params.penalty
    keep[-1, -1] = 1e-6
    for _ in range(60):  # Newton steps on the squared hinge
        active = y * (x @ w) < 1
        xa = x[active] * cost[active][:, None]
        new = np.linalg.solve(keep + xa.T @ x[active], xa.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    weights = marks.T @ (root @ w[:-1])
    return (columns >> np.uint64(32)).astype(np.int64), (columns & np.uint64(0xFFFFFFFF)).astype(np.uint32), weights.astype(np.float32), float(w[-1])


def _units(column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first row, end row, distinct words, which word, its row) over chunks, runs of single letters added."""
    for at in range(0, len(column), SLICE_ROWS):
        lower = pa.array([(t or "").lower() for t in column[at : at + SLICE_ROWS].to_pylist()], pa.large_string())
        for lo, hi, data, offsets in chunks(lower):
            starts, ends, rows = words(data, offsets)
            raw = data.tobytes()
            _, first, which = np.unique(Hasher(data)(starts, ends), return_index=True, return_inverse=True)
            units = [raw[a:b].decode("utf-8", "replace").replace("\n", "") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            single = np.concatenate(([False], chars[ends] - chars[starts] == 1, [False]))
            turn = np.flatnonzero(single[1:] != single[:-1])
            more, more_rows = [], []
            for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
                for r in np.unique(rows[a:b]):
                    run = np.arange(a, b)[rows[a:b] == r]
                    if len(run) >= 3:
                        more.append(raw[starts[run[0]] : ends[run[-1]]].decode("utf-8", "replace").replace("\n", " "))
                        more_rows.append(r)
            yield at + lo, at + hi, units + more, np.concatenate([which, np.arange(len(units), len(units) + len(more))]).astype(np.int64), np.concatenate([rows, np.array(more_rows, dtype=np.int64)])


def text_features(column: pa.Array, scorer: WordScorer) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features): largest margin, and log of 1 + words with a positive one."""
    for lo, hi, units, which, rows in _units(column):
        margin = scorer(units)[which] if len(units) else np.zeros(0)
        top = np.full(hi - lo, scorer.bias)
        np.maximum.at(top, rows, margin)
        yield lo, hi, np.column_stack([top, np.log1p(np.bincount(rows, weights=margin > 0, minlength=hi - lo))])


@dataclass
class ToxicityModel:
    slots: np.ndarray
    checks: np.ndarray
    weights: np.ndarray
    bias: float
    logistic: np.ndarray  # of the two features and 1

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = np.hstack([features, np.ones((len(features), 1))]) @ self.logistic
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fits on at most params.train_rows labelled rows outside the held-out fold (crc32 of the id's text modulo 5 is 0).

    Labels other than 0 and 1 are left out. Of near copies (FAMILY_MINIMA) only the text with the smallest id is learnt
    from: copies repeat one label, they don't confirm it. Where no word marks toxic texts enough (least_texts,
    least_share, least_evidence), there is nothing to fit: the model scores every text near 0, with a warning.
    """
    modest_batches(spark)
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where("toxic IN (0, 1) AND id IS NOT NULL").where(~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(params.train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")

    @lean
    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families = np.zeros(batch.num_rows, dtype=np.int64)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                starts, ends, rows = words(data, offsets)
                grams, of = shingle_hashes(Hasher(data)(starts, ends), rows, 3)
                lone = np.bincount(of, minlength=hi - lo) == 0  # fewer than three words: a family of equal texts
                family = np.zeros(hi - lo, dtype=np.uint64)
                for seed in range(FAMILY_MINIMA):
                    low = np.full(hi - lo, np.iinfo(np.uint64).max)
                    np.minimum.at(low, of, mix(grams ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                    family = mix(family * np.uint64(31) + low)
                families[lo:hi] = np.where(lone, batch.column(3)[lo:hi].to_numpy(), family.view(np.int64))
            for lo, hi, units, which, rows in _units(batch.column(1)):
                pairs = np.unique(np.column_stack([rows, which]), axis=0)
                cut = np.searchsorted(pairs[:, 0], np.arange(hi - lo + 1))
                held = [[w for i in pairs[a:b, 1] for w in windows(units[i])] for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi].cast(pa.int32()), pa.array(families[lo:hi]), pa.array(held, pa.list_(pa.string()))], names=["id", "toxic", "family", "words"])

    texts = written(spark, texts.select("id", "text", "toxic"), "labelled")
    # One text of each family of near copies, so that copies don't make words look telling: that with the smallest
    # id, so that each run fits the same machine.
    kind = texts.schema["id"].dataType.simpleString()
    of = texts.withColumn("own", F.xxhash64("text")).mapInArrow(to_words, f"id {kind}, toxic int, family long, words array<string>")
    seen = written(spark, of.groupBy("family").agg(F.min(F.struct("id", "toxic", "words")).alias("first")).select("first.toxic", "first.words"), "families")
    counted = written(spark, seen.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "words")
    share = seen.agg(F.avg("toxic")).first()[0] or 0.0
    by_chance = F.col("n") * max(share, 1e-6)
    evidence = F.col("t") * F.log(F.col("t") / by_chance) - (F.col("t") - by_chance)
    marked = counted.where((F.col("t") >= params.least_texts) & (F.col("t") >= params.least_share * F.col("n"))).where(evidence >= params.least_evidence)
    bad = [r["word"] for r in marked.orderBy(F.desc(evidence), "word").limit(params.positives).collect()]
    clean = counted.where("4 * t <= n")
    good = [r["word"] for r in clean.orderBy(F.desc("n"), "word").limit(params.negatives // 3).collect()] + [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(params.negatives // 3).collect()]
    if not bad or not good:
        warnings.warn("no word marks the toxic texts enough to fit a machine: every text will score near 0", stacklevel=2)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0, np.array([0.0, 0.0, -30.0]))
    model = ToxicityModel(*train_words(good, bad, params), np.zeros(3))

    @lean
    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = WordScorer(model.slots, model.checks, model.weights, model.bias)
        for pdf in batches:
            yield pdf.assign(margin=scorer(pdf["word"].str.replace("\n", " ").tolist()))

    # The clean words nearest to the bad ones go into a second fit.
    near = clean.select("word").mapInPandas(margins, "word string, margin double").orderBy(F.desc("margin"), "word").limit(params.negatives // 3)
    model = ToxicityModel(*train_words(list(dict.fromkeys(good + [r["word"] for r in near.collect()])), bad, params), np.zeros(3))
    scored = _features(texts, model).toPandas().sort_values(["top", "hits", "toxic"])
    model.logistic = _logistic(scored[["top", "hits"]].to_numpy(), scored["toxic"].to_numpy(dtype=float))
    drop(texts, seen, counted)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScorer(model.slots, model.checks, model.weights, model.bias)
        for batch in batches:
            for lo, hi, x in text_features(batch.column(0), scorer):
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)[lo:hi].cast(pa.int32())], names=["top", "hits", "toxic"])

    return texts.select("text", "toxic").mapInArrow(run, "top double, hits double, toxic int")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted): the probability that a text is toxic, and whether it is at least a half.

    Null and empty texts have the score of a text without telling words. Repeated rows score alike; other columns are left out.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScorer(model.slots, model.checks, model.weights, model.bias)
        for batch in batches:
            for lo, hi, x in text_features(batch.column(1), scorer):
                p = model.probabilities(x)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, all columns as they were. Only texts go to Python, and only flags back."""

    @F.arrow_udf("boolean")
    @lean
    def toxic(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = WordScorer(model.slots, model.checks, model.weights, model.bias)
        for part in parts:
            flags = [model.probabilities(x) >= 0.5 for _, _, x in text_features(part, scorer)]
            yield pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))

    return docs.where(~toxic(docs[text_col].cast("string")))
