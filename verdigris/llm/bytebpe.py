"""Byte-level BPE by a hierarchical-bitmap rank queue, for pre-tokens of any length."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the table of pre-tokens in a Python worker; a full table is emptied.
TABLE_ENTRIES = 1_000_000
#: Longest pre-token kept in the table, in characters.
LONGEST_KEPT = 64
#: Pre-tokens handled at once.
BLOCK = 50_000


class RankQueue:
    """Buckets of list positions by merge rank; three bitmap levels of 64-way words find the lowest rank.

    Entries are never removed when a neighbour's merge outdates them: pop() hands them out and the
    caller skips them. Positions of one rank come out from left to right.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int]:
        """(rank, position), or (-1, -1) when empty."""
        top = self.top
        if not top:
            return -1, -1
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] &= ~(1 << (rank & 63))
            if not self.low[a]:
                self.mid[b] &= ~(1 << (a & 63))
                if not self.mid[b]:
                    self.top &= ~(1 << b)
        return rank, position


class Table(dict):
    """Comma-joined ids by pre-token; a missing one is merged, and kept unless it is long."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, pretoken: str) -> str:
        found = ",".join(map(str, self.merge(pretoken.encode("utf-8"))))
        if len(pretoken) <= LONGEST_KEPT:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[pretoken] = found
        return found


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern)
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.table = Table(self.merge)
        self.bytes_of = {str(v): k for k, v in self.ranks.items()}

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(token)) is not None:
            return [whole]
        n, push, pop = len(token), self.queue.push, self.queue.pop
        end = list(range(1, n + 1))  # of the part that starts at a position
        before = list(range(-1, n - 1))
        get = ranks.get
        pair = [get(token[i : i + 2], -1) for i in range(n)]  # rank that merges the part with the next one
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        while True:
            rank, i = pop()
            if rank < 0:
                break
            if pair[i] != rank:
                continue
            j = end[i]
            end[i] = k = end[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                pair[i] = r = get(token[i : end[k]], -1)
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            if (h := before[i]) >= 0:
                pair[h] = r = get(token[h:k], -1)
                if r >= 0:
                    push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[token[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> Iterator[str]:
        """Comma-joined ids of the text, by blocks of pre-tokens."""
        matches = self.find.finditer(text) if len(text) > 1_000_000 else None
        if matches is None:
            if tokens := self.find.findall(text):
                yield ",".join(map(self.table.__getitem__, tokens))
            return
        while block := [m.group() for m in islice(matches, BLOCK)]:
            yield ",".join(map(self.table.__getitem__, block))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(",")))


_made: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(path, pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids (array<int>) of each text; null and empty texts have no ids. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [[int(i) for block in bpe.encode(t or "") for i in block.split(",")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that ids stand for; null and empty lists give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {int(k): v for k, v in byte_bpe(vocabulary, pattern).bytes_of.items()}
        for batch in batches:
            out = [b"".join(map(bytes_of.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of tokens, and digests of the ids and of the bytes decoded from them.

    Encodes and decodes in one pass, so ids needn't leave the task. Null and empty texts have
    0 tokens and the digest of nothing; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in batches:
            count, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for block in bpe.encode(value.as_py() or ""):
                    of_ids.update((("," if n else "") + block).encode("ascii"))
                    of_text.update(bpe.decode(block))
                    n += block.count(",") + 1
                count.append(n)
                ids_hex.append(of_ids.hexdigest())
                text_hex.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
