"""What a task holds beside its texts."""

import ctypes
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from verdigris.llm import jaccard, suffixdedup, wordbpe
from verdigris.llm.arrays import CHUNK_BYTES


def _peak(f, *args):
    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_repeats_are_hashed_in_blocks():
    """Cutting took 25 times the bytes of the texts, and a bucket with a passage of a third of them 3.5 times those of its strings."""
    rng = np.random.default_rng(3)
    hot = rng.integers(97, 123, 400, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 1200, dtype=np.uint8), hot if i % 3 == 0 else hot[:0]]) for i in range(1200)]
    data, offsets = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    (row, start, windows, anchors), cut = _peak(suffixdedup.cut_strings, data, offsets, 50)
    assert cut < 18 * len(data)
    strings = suffixdedup.gather(data, offsets[row] + start, windows + 49)
    (ids, begin, end), most = _peak(suffixdedup.removals, row, start, anchors, windows.astype(np.uint8), strings, 50)
    assert most < 2 * len(strings)
    gone = {i: np.zeros(len(t), dtype=bool) for i, t in enumerate(texts)}
    for i, a, b in zip(ids.tolist(), begin.tolist(), end.tolist()):
        gone[i][a:b] = True
    assert all(g[1200:].all() and not g[:1190].any() for i, g in gone.items() if i % 3 == 0 and i)
    assert not any(g.any() for i, g in gone.items() if i % 3 or not i)


def test_blocks_do_not_change_anchors_and_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000, dtype=np.uint8)
    lengths = np.array([50, 1, 700, 0, 49, 113, 64])
    whole = suffixdedup.window_anchors(data, 50), suffixdedup._hashes(data, lengths), suffixdedup._hashes(data, lengths[[0, 2, 5, 6]], 50), suffixdedup.gather(data, np.array([5, 9, 0, 3, 700, 40, 1]), lengths)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 100)
    again = suffixdedup.window_anchors(data, 50), suffixdedup._hashes(data, lengths), suffixdedup._hashes(data, lengths[[0, 2, 5, 6]], 50), suffixdedup.gather(data, np.array([5, 9, 0, 3, 700, 40, 1]), lengths)
    assert all(np.array_equal(a, b) for a, b in zip(whole, again))
    assert len(suffixdedup.window_anchors(data[:49], 50)) == 0


def test_powers_of_the_tokenizers_texts_are_kept():
    assert wordbpe.TEXT_BYTES <= CHUNK_BYTES


def test_tasks_give_back_what_they_have_freed():
    """Spark keeps workers for later tasks: they stood beside a heap that was full by then with memory that nobody used."""
    trim = ctypes.CDLL(None).malloc_trim
    size = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 4000, 900))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    join = object.__new__(jaccard.NgramJaccard)
    join.k, join.t = 5, jaccard.Threshold(80, 100)
    trim(0)
    for made in join._summarise()(iter([batch] * 4)):
        del made
    kept = size()
    trim(0)
    assert kept - size() < 2
