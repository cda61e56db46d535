"""Token ids of the lower-casing word BPE, found once for each distinct run of non-blank text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrays import CHUNK_BYTES, LOWER, Hasher, chunks, words

#: Runs known to a Python worker at most; a full table is emptied.
TABLE_ENTRIES = 2_000_000
#: Bytes of text encoded at once: as many as a worker keeps powers for.
TEXT_BYTES = CHUNK_BYTES
#: Runs encoded in one call.
CALL_RUNS = 4096


def _split_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full stop or comma after an a-z letter at the end of a run is a run of its own, as it is to the tokenizer."""
    last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
    cut = np.flatnonzero((ends - starts > 1) & ((last == ord(".")) | (last == ord(","))) & (before >= ord("a")) & (before <= ord("z")))
    marks = ends[cut] - 1
    kept = ends.copy()
    kept[cut] = marks
    return np.insert(starts, cut + 1, marks), np.insert(kept, cut + 1, marks + 1), np.insert(rows, cut + 1, rows[cut])


class WordTokens:
    """Texts are cut at ASCII blanks: the tokenizer drops white space and never merges across it.

    A run is known by its 64-bit hash. Hashes are kept sorted, with the place of each run's ids in one pool.
    With plain, the strings of special tokens are text like any other; else they become those tokens.
    """

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.empty()

    def _lowered(self, data: np.ndarray) -> np.ndarray:
        """In lower case, but for special tokens and what would turn into one: those are told by their case."""
        low = LOWER[data]
        if self.special:
            raw = low.tobytes()
            for token in self.special:
                at = raw.find(token)
                while at >= 0:
                    low[at : at + len(token)] = data[at : at + len(token)]
                    at = raw.find(token, at + 1)
        return low

    def empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(1 << 20, dtype=np.uint16)
        self.used = 0

    def learn(self, keys: np.ndarray, runs: list[str]) -> None:
        """keys ascending, and not known yet."""
        sizes = np.zeros(len(runs), dtype=np.int32)
        start = self.used
        for lo in range(0, len(runs), CALL_RUNS):
            part = runs[lo : lo + CALL_RUNS]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, begins = np.array(found.ids, dtype=np.uint16), np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
            run = np.searchsorted(np.cumsum(lengths) - lengths, begins, side="right") - 1
            sizes[lo : lo + len(part)] = np.bincount(run, minlength=len(part))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, start + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        data = self._lowered(data)
        starts, ends, rows = _split_marks(data, *words(data, offsets))
        keys, first, where = np.unique(Hasher(data)(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > TABLE_ENTRIES:
            self.empty()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw, of = data.tobytes(), first[new]
            self.learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[of].tolist(), ends[of].tolist())])
            at = np.searchsorted(self.keys, keys)
        run = at[where]
        begin, count = self.place[run], self.size[run].astype(np.int64)
        done = np.cumsum(count)
        ids = self.pool[np.arange(done[-1] if len(done) else 0) + np.repeat(begin - done + count, count)].astype(np.uint32)
        return ids, np.bincount(rows, weights=count, minlength=len(offsets) - 1).astype(np.int64)


_made: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(path: str, plain: bool) -> WordTokens:
    """One per worker process and kind, kept for later tasks."""
    if (path, plain) not in _made:
        _made[path, plain] = WordTokens(path, plain)
    return _made[path, plain]


def encoded(column: pa.Array, path: str, end_id: int, plain: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets of rows in ids) over chunks; each text's ids end in end_id."""
    tokens = word_tokens(path, plain)
    for lo, hi, data, offsets in chunks(column, TEXT_BYTES):
        ids, count = tokens.encode(data, offsets)
        bounds = np.concatenate(([0], np.cumsum(count)))
        yield lo, hi, np.insert(ids, bounds[1:], end_id), bounds + np.arange(hi - lo + 1)
