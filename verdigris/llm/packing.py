"""Packing by power-of-two decomposition: binary-length pieces, one piece a sequence, no padding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, modest_batches
from .wordbpe import encoded


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of pieces: as many of the longest as fit, then the binary digits of the rest, high to low."""
    pieces = [(s, longest) for s in range(0, n - n % longest, longest)]
    at = n - n % longest
    for k in range(longest.bit_length() - 1, -1, -1):
        if (n - at) >> k & 1:
            pieces.append((at, 1 << k))
            at += 1 << k
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, longest: int = 2048, plain: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with their token ids, one row each; no shuffle.

    A document is its ids and end_id. A piece fills a sequence of its own length, a power of two,
    so bucket (log2 of the length) gathers sequences of one shape, no sequence crosses documents and
    none is padded. Null and empty texts give one piece holding end_id. Repeated rows are packed
    again; sequence_id is unique among all rows, and the same on each run over the same files.
    Extra columns are left out. token_ids holds little-endian unsigned 32-bit ids. The strings of special tokens in a
    text give those tokens, as the tokenizer does by itself; with plain, they are text like any other.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, ids, bounds in encoded(batch.column(1), vocabulary, end_id, plain):
                raw = memoryview(ids.astype("<u4").tobytes())
                row, start, length, pieces, total = [], [], [], [], []
                for r, (at, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), lo):
                    for s, m in binary_pieces(end - at, longest):
                        row.append(r)
                        start.append(s)
                        length.append(m)
                        pieces.append(raw[4 * (at + s) : 4 * (at + s + m)])
                        total.append(end - at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(pieces, pa.binary()), pa.array(total, pa.int64())],
                    names=[id_col, "start", "length", "token_ids", "doc_tokens"],
                )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, token_ids binary, doc_tokens long"
    modest_batches(docs.sparkSession)
    pieces = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, schema)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
