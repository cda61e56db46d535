"""Token counts by scanning flat, unindexed token files for end-of-document identifiers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import open_folder
from .shared import scratch_path, written
from .wordbpe import encoded

#: Tokens in a block of the scan.
BLOCK_TOKENS = 1 << 21


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each partition's ids as one flat file of little-endian unsigned 16-bit ids, each text closed by end_id.

    Returns (file, file_tokens, ordinal, id): which text is the ordinal-th of a file, nothing about its
    length. A file is named anew on each attempt, so a retried or speculative task never
    overwrites another's. Null and empty texts leave a lone end_id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, n, tokens, out = f"{path}/{uuid.uuid4().hex}.u16", 0, 0, None
        try:
            for batch in batches:
                for lo, hi, ids, _ in encoded(batch.column(1), vocabulary, end_id, plain=True):
                    out = out or system.open_output_stream(name, compression=None)
                    out.write(ids.astype("<u2").tobytes())
                    tokens += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (hi - lo)), pa.array(np.arange(n, n + hi - lo), pa.int64()), batch.column(0)[lo:hi]], names=["file", "ordinal", id_col])
                    n += hi - lo
        finally:
            if out:
                out.close()

    if end_id >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    schema = f"file string, ordinal long, `{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(write, schema)


def scan_token_files(spark: SparkSession, folder: str, files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every text in the files named by files.file, without the end id.

    Each block is searched on its own; a prefix scan over the blocks' counts and last separators
    then numbers the texts and measures those that cross blocks. Ids after the last separator
    of a file form no text.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = open_folder(folder)
        for pdf in batches:
            for name in pdf["file"]:
                n = system.get_file_info(name).size // 2
                yield pd.DataFrame({"file": name, "block": np.arange(-(-n // block_tokens), dtype=np.int64)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(2 * block_tokens, 2 * block_tokens * block), dtype="<u2")
                found = np.flatnonzero(ids == end_id).astype(np.int64) + block * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["file", "block", "found"])

    blocks = files.select("file").mapInPandas(cut, "file string, block long").repartition("file", "block")
    searched = written(spark, blocks.mapInArrow(search, "file string, block long, found array<bigint>"), "separators")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = searched.select("file", "block", F.size("found").alias("n"), F.try_element_at("found", F.lit(-1)).alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.coalesce(F.last("last", ignorenulls=True).over(ahead), F.lit(-1)).alias("carry")
    )
    return (
        searched.join(scan, ["file", "block"])
        .select("file", "base", "carry", "found", F.posexplode("found").alias("i", "at"))
        .select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("at") - F.when(F.col("i") == 0, F.col("carry")).otherwise(F.col("found")[F.col("i") - 1]) - 1).alias("n_tokens"))
    )


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_tokens) of each row, counted by a scan of token files written to the shared folder.

    Null and empty texts count 0; repeated rows are counted each; an empty table gives none. Strings of special tokens
    in a text are counted as the text they are: as tokens they would pass for separators.
    """
    folder = scratch_path(spark, "tokens")
    manifest = written(spark, write_token_files(docs, vocabulary, end_id, folder, id_col, text_col), "token-manifest")
    files = manifest.select("file").distinct()
    return manifest.join(scan_token_files(spark, folder, files, end_id, block_tokens), ["file", "ordinal"], "left").select(id_col, "n_tokens", "file", "ordinal")
