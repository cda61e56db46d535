"""Quality rules: counts over whole texts and zstandard compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hasher, IS_SPACE, chunks, shingle_hashes, words

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class CompressionBands:
    """Limits on raw bytes / compressed bytes.

    whole: (least UTF-8 bytes, lowest ratio, highest ratio), ascending; the last band whose
    least size the text reaches holds. Texts under the first band have no verdict (kept).
    chunk_bytes: each fixed chunk of that size (a shorter tail counts with the chunk before it)
    must lie in chunk_band, but for a share of at most chunk_tolerance of the chunks.
    """

    whole: tuple[tuple[int, float, float], ...] = ((200, 0.95, 4.0), (1000, 1.2, 6.0), (4000, 1.5, 8.0), (16000, 1.7, 10.0))
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (1.3, 12.0)
    chunk_tolerance: float = 0.34
    level: int = 3


def compression(text: bytes, bands: CompressionBands, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks, chunks outside the band, verdict)."""
    n = len(text)
    if not n:
        return 0.0, 0, 0, True
    ratio = n / len(press.compress(text))
    band = next((b for b in reversed(bands.whole) if n >= b[0]), None)
    kept = band is None or band[1] <= ratio <= band[2]
    starts = list(range(0, max(1, n - n % bands.chunk_bytes), bands.chunk_bytes))
    outside = 0
    if n >= 2 * bands.chunk_bytes:
        for i, s in enumerate(starts):
            part = text[s : n if i == len(starts) - 1 else s + bands.chunk_bytes]
            outside += not bands.chunk_band[0] <= len(part) / len(press.compress(part)) <= bands.chunk_band[1]
        kept = kept and outside <= bands.chunk_tolerance * len(starts)
    return ratio, len(starts), outside, kept


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: CompressionBands = CompressionBands()) -> DataFrame:
    """Counts, compression ratios and the verdict of each text.

    Null and empty texts have no words, counts of 0, base_failed true and kept false. Repeated
    rows give repeated results; extra columns are left out. Lines and words compare by bytes.
    n_repeat_words counts word positions inside a 5-word window that occurs twice or more.
    """

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                n = hi - lo
                starts, ends, rows = words(data, offsets)
                n_words = np.bincount(rows, minlength=n)
                lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
                chars = np.bincount(rows, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64)
                grams, gram_rows = shingle_hashes(Hasher(data)(starts, ends), rows, 5)
                keyed = grams ^ (gram_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, where, counts = np.unique(keyed, return_inverse=True, return_counts=True)
                covered = np.zeros(len(rows) + 1, dtype=np.int64)
                at = np.flatnonzero(rows[: max(0, len(rows) - 4)] == rows[4:])[counts[where] > 1] if len(grams) else np.zeros(0, np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + 5, -1)
                repeats = np.bincount(rows, weights=np.cumsum(covered[:-1]) > 0, minlength=n).astype(np.int64)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                pressed = [compression(t, bands, press) for t in texts]
                failed = (n_words < 10) | (100 * repeats > 20 * n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi], pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]], pa.int64()),
                        pa.array([_line_repeats(t) for t in texts], pa.int64()), pa.array(repeats, pa.int64()), pa.array(failed), pa.array([p[0] for p in pressed], pa.float64()),
                        pa.array([p[1] for p in pressed], pa.int64()), pa.array([p[2] for p in pressed], pa.int64()), pa.array(~failed & np.array([p[3] for p in pressed], dtype=bool)),
                    ],
                    names=names,
                )

    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "n_chunks", "n_chunks_outside", "kept"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_chunks_outside long, kept boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(rules, schema)
