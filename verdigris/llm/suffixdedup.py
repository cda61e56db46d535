"""Removal of long repeated byte strings across documents, by run-compressed indexes over dealt-out strings.

Every window of `long` bytes belongs to the least hash among its `GRAM`-byte strings. Runs of windows with one such
anchor make a short string, and strings are dealt out by anchor, so all occurrences of a window meet in one task,
however far apart their documents are; none needs another task's text. There, strings are trimmed to windows whose
fingerprint occurs again; what is left forms a run-compressed index, and the matching statistics of the same
strings, streamed through it, tell the smallest document that holds each window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Hasher, chunks, mix
from .rindex import RunIndex
from .shared import drop, lean, modest_batches, with_key_columns, written

GRAM = 12
#: Windows of a dealt string at most; text bytes for each bucket; bytes of text cut at once.
RUN, BUCKET_BYTES, CUT_BYTES = 64, 2 << 20, 4 << 20
#: Bytes hashed or gathered at once: arrays of 8 bytes a byte of text stand beside them.
BLOCK_BYTES = 1 << 18
#: Ids are broadcast up to this many rows (8 bytes each); beyond it the texts are shuffled to them.
BROADCAST_ROWS = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings at each position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = data.tobytes() + bytes(8)
    words = np.empty(len(data) + 1, dtype=np.uint64)
    for i in range(8):
        part = np.frombuffer(raw, dtype="<u8", count=(len(raw) - i) // 8, offset=i)
        words[i::8] = part[: len(words[i::8])]
    x = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (words[GRAM - 8 : GRAM - 8 + n] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x over each run of width positions."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def window_anchors(data: np.ndarray, long: int) -> np.ndarray:
    """The least hash among the GRAM-byte strings of each window of long bytes."""
    anchors = np.empty(max(0, len(data) - long + 1), dtype=np.uint64)
    for at in range(0, len(anchors), BLOCK_BYTES):
        part = data[at : min(at + BLOCK_BYTES, len(anchors)) + long - 1]
        anchors[at : at + BLOCK_BYTES] = sliding_min(gram_hashes(part), long - GRAM + 1)
    return anchors


def cut_strings(data: np.ndarray, offsets: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row's text, windows, anchor) of the strings that hold all windows of all texts."""
    anchors = window_anchors(data, long)
    n = len(anchors)
    sizes = np.diff(offsets)
    if not n or not (sizes >= long).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.empty(n, dtype=bool)
    new[0], new[1:] = True, anchors[1:] != anchors[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    begins = np.flatnonzero(new)
    row = np.searchsorted(offsets, begins, side="right") - 1
    last = offsets[row + 1] - long + 1  # windows of the row end here
    begins, row, last = (x[begins < last] for x in (begins, row, last))
    ends = np.minimum(np.append(begins[1:], n), last)
    pieces = -(-(ends - begins) // RUN)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row, ends, begins = np.repeat(row, pieces), np.repeat(ends, pieces), np.repeat(begins, pieces) + nth * RUN
    return row, begins - offsets[row], np.minimum(ends - begins, RUN), anchors[begins]


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of strings of at most BLOCK_BYTES together, or one longer string."""
    done, at = np.concatenate(([0], np.cumsum(lengths))), 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(done, done[at] + BLOCK_BYTES, side="right")) - 1)
        yield at, end
        at = end


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out, at = np.empty(int(lengths.sum()), dtype=data.dtype), 0
    for a, b in _blocks(lengths):
        done = np.cumsum(lengths[a:b])
        out[at : at + done[-1]] = data[np.arange(done[-1]) + np.repeat(starts[a:b] - done + lengths[a:b], lengths[a:b])]
        at += int(done[-1])
    return out


def _hashes(strings: np.ndarray, lengths: np.ndarray, long: int = 0) -> np.ndarray:
    """Hashes of strings that stand one after another; with long, of all windows of long bytes in each."""
    out, at = [np.zeros(0, np.uint64)], 0
    for a, b in _blocks(lengths):
        ends = np.cumsum(lengths[a:b])
        begins, size = ends - lengths[a:b], int(ends[-1])
        if long:
            own, nth = _each(lengths[a:b] - long + 1)
            begins = begins[own] + nth
            ends = begins + long
        out.append(Hasher(strings[at : at + size])(begins, ends))
        at += size
    return np.concatenate(out)


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. count - 1 for each count, and whose they are."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)


def _packed(ids: np.ndarray, starts: np.ndarray, windows: np.ndarray, anchors: np.ndarray, strings: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    tags = (anchors & np.uint64(0xFFFFFFFF)).astype("<u4")
    return press.compress(b"".join([np.int64(len(ids)).tobytes(), ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), tags.tobytes(), windows.astype(np.uint8).tobytes(), strings.tobytes()]))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in ("<i8", "<i8", "<u4", "u1"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return *out, np.frombuffer(raw, np.uint8, -1, at)


def removals(ids: np.ndarray, starts: np.ndarray, anchors: np.ndarray, windows: np.ndarray, strings: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, begin, end) of byte runs to remove, from all strings of some anchors.

    Strings whose anchor is in one document only, and windows whose fingerprint is alone, can't repeat; equal strings
    are taken once, trimmed to what lies between the other windows, and only those go into the index.
    """
    none = (np.zeros(0, np.int64),) * 3
    windows = windows.astype(np.int64)
    lengths = windows + long - 1
    offsets = np.cumsum(lengths) - lengths
    order = np.argsort(anchors)
    group = np.flatnonzero(np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])))
    differ = np.minimum.reduceat(ids[order], group) < np.maximum.reduceat(ids[order], group)
    use = np.sort(order[np.repeat(differ, np.diff(np.append(group, len(order))))])
    if not len(use):
        return none
    ids, starts, windows, lengths, offsets = (x[use] for x in (ids, starts, windows, lengths, offsets))
    strings = gather(strings, offsets, lengths)
    offsets = np.cumsum(lengths) - lengths
    _, one, variant = np.unique(_hashes(strings, lengths), return_index=True, return_inverse=True)
    strings, lengths = gather(strings, offsets[one], lengths[one]), lengths[one]
    offsets = np.cumsum(lengths) - lengths
    owner, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(owner, variant, ids)
    np.maximum.at(most, variant, ids)
    own, nth = _each(windows[one])
    prints = _hashes(strings, lengths, long)
    order = np.argsort(prints)
    prints = prints[order]
    same = prints[1:] == prints[:-1]
    open_ = (owner < most)[own]
    open_[order[1:][same]] = open_[order[:-1][same]] = True
    del order, prints, same
    own, nth = own[open_], nth[open_]
    if not len(own):
        return none
    lead = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    use, first, last = own[lead], nth[lead], nth[np.append(lead[1:], len(own)) - 1]
    sizes = last - first + long
    strings = gather(strings, offsets[use] + first, sizes)
    begins = np.cumsum(sizes) - sizes
    _, trimmed, as_trimmed = np.unique(_hashes(strings, sizes), return_index=True, return_inverse=True)
    least_id = np.full(len(trimmed), np.iinfo(np.int64).max)
    np.minimum.at(least_id, as_trimmed, owner[use])
    texts = gather(strings, begins[trimmed], sizes[trimmed])
    _, least = RunIndex(texts, sizes[trimmed], least_id, long).matching_statistics(texts, sizes[trimmed], long)
    place = (np.cumsum(sizes[trimmed]) - sizes[trimmed])[as_trimmed]
    # Each occurrence of a string: the trimmed windows whose smallest document is smaller than its own.
    nth_use = np.full(len(one), -1)
    nth_use[use] = np.arange(len(use))
    hit = np.flatnonzero(nth_use[variant] >= 0)
    kind = nth_use[variant[hit]]
    own, nth = _each((sizes - long + 1)[kind])
    gone = least[place[kind][own] + nth] < ids[hit][own]
    own, nth = own[gone], nth[gone]
    if not len(own):
        return none
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (nth[1:] != nth[:-1] + 1))))
    end = nth[np.append(new[1:], len(own)) - 1] + long
    own, nth = own[new], nth[new]
    shift = starts[hit][own] + first[kind[own]]
    return ids[hit][own], shift + nth, shift + end


def _gone(spans: pa.ListScalar, size: int) -> np.ndarray:
    """Which of size bytes some span covers."""
    begin, end = (spans.values.field(i).to_numpy() for i in (0, 1))
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, np.minimum(begin, size), 1)
    np.add.at(change, np.minimum(end, size), -1)
    return np.cumsum(change[:-1]) > 0


class SuffixDedup:
    def __init__(self, spark: SparkSession, docs: DataFrame, long: int = 50, id_col: str = "doc_id", text_col: str = "text"):
        if long < GRAM + 8:
            raise ValueError(f"long must be {GRAM + 8} or more")
        modest_batches(spark)
        self.spark, self.long = spark, long
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def _with(self, ids: DataFrame, how: str) -> DataFrame:
        return self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", how)

    def spans(self) -> DataFrame:
        """(id, begin, end): byte runs to remove, as found; they overlap. Whole copies aren't among them."""
        long = self.long
        sized = self.docs.where("id IS NOT NULL").select("id", F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
        sized = written(self.spark, sized, "digests")
        total = sized.agg(F.sum("n")).first()[0] or 0
        buckets = max(1, -(-total // BUCKET_BYTES))
        lead = sized.where(F.col("n") >= long).groupBy("digest").agg(F.min("id").alias("lead"), F.max("id").alias("most"), F.count(F.lit(1)).alias("rows"))
        lead = written(self.spark, lead.where("lead < most").select("digest", "lead", "rows"), "equal-texts")
        self.copies = written(self.spark, with_key_columns(sized, lead, ["digest"], "rows", sized.count(), "inner").where("id > lead").select("id").distinct(), "copies")
        drop(sized, lead)

        @lean
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for lo, _, data, offsets in chunks(batch.column(1), CUT_BYTES):
                    row, start, windows, anchor = cut_strings(data, offsets, long)
                    if not len(row):
                        continue
                    bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    row, start, windows, anchor, bucket = (x[order] for x in (row, start, windows, anchor, bucket))
                    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                    blobs = []
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        strings = gather(data, offsets[row[a:b]] + start[a:b], windows[a:b] + long - 1)
                        blobs.append(_packed(ids[lo + row[a:b]], start[a:b], windows[a:b], anchor[a:b], strings, press))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "strings"])

        @lean
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [_unpacked(b) for pdf in batches for b in pdf["strings"]]
            yield pd.DataFrame(dict(zip(("id", "begin", "end"), removals(*(np.concatenate(x) for x in zip(*parts)), long))))

        texts = self._with(self.copies, "left_anti").where(F.col("id").isNotNull() & (F.octet_length("text") >= long))
        return texts.mapInArrow(cut, "bucket long, strings binary").groupBy("bucket").applyInPandas(search, "id long, begin long, end long")

    def _by_document(self) -> DataFrame:
        spans = written(self.spark, self.spans(), "repeats")
        copies = self.copies.select("id", F.lit(0).cast("long").alias("begin"), F.lit(1 << 62).cast("long").alias("end"))
        by_doc = written(self.spark, spans.unionByName(copies).groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "repeats-by-document")
        drop(spans, self.copies)
        return by_doc

    def rewritten(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """docs, all columns kept whatever they are called, with the repeats cut from the texts; parts of cut characters
        go too. Null texts and rows without an id stay as they are.
        """
        own_id, own_spans = (f"{name}_{uuid.uuid4().hex}" for name in ("id", "spans"))
        by_doc = self._by_document().select(F.col("id").alias(own_id), F.col("spans").alias(own_spans))
        text_at, columns = docs.columns.index(text_col), len(docs.columns)

        @lean
        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offsets in chunks(batch.column(text_at)):
                    part = batch.slice(lo, hi - lo)
                    left = [data[a:b][~_gone(part.column(columns)[r], b - a)].tobytes().decode("utf-8", "ignore") for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]))]
                    arrays = part.columns[:columns]
                    arrays[text_at] = pa.array(left, pa.string())
                    yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names[:columns])

        ids = by_doc.select(own_id)
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        same = docs[id_col].cast("long") == F.col(own_id)
        hit = docs.join(ids, same, "left_semi").join(by_doc, same)
        hit = hit.select(*[docs[c] for c in docs.columns], own_spans).mapInArrow(rewrite, docs.schema)
        return hit.unionByName(docs.join(ids, same, "left_anti"))

    def kept(self) -> DataFrame:
        """(id, n_bytes, n_removed, n_spans, kept): one row per row of docs; kept has the remaining bytes."""
        by_doc = self._by_document()

        @lean
        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offsets in chunks(batch.column(1)):
                    removed, n_spans, left = [], [], []
                    for r in range(hi - lo):
                        text = data[offsets[r] : offsets[r + 1]]
                        gone = _gone(batch.column(2)[lo + r], len(text))
                        removed.append(int(gone.sum()))
                        n_spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0)
                        left.append(text[~gone].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[lo:hi], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary())],
                        names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
                    )

        ids = by_doc.select("id")
        hit = self._with(ids, "left_semi").join(by_doc, "id").select("id", "text", "spans").mapInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
        none = F.lit(0).cast("long")
        clean = self._with(ids, "left_anti").select("id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
        return hit.unionByName(clean)


def remove_repeats(spark: SparkSession, docs: DataFrame, long: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each byte is removed that a string of `long` bytes covers which also
    starts in a document with a smaller id. Strings are judged on the input; matches never cross documents.

    Null and empty texts have 0 bytes. Rows that repeat an id are one document: neither removes the other's bytes.
    Rows without an id are left as they are and remove nothing. kept may end inside a character. Other columns are left out.
    """
    return SuffixDedup(spark, docs, long, id_col, text_col).kept().withColumnRenamed("id", id_col)
