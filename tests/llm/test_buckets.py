"""Buckets of the nearest-neighbour search: how many there are, and what a task finds in them."""

import numpy as np
import pytest

from verdigris.llm import ann


def test_buckets_are_not_cut_until_empty():
    """At 600,000 vectors a third rotation made 2 million buckets a table, of which each query looked into 8,192, in a thousand tasks."""
    of = lambda n, axes=128: ann.leading(n, axes, ann.CrossPolytope())
    assert [of(n) for n in (0, 1, 2_000, 51_282, 524_288, 615_384, 30_000_000, 40_000_000)] == [1, 1, 1, 1, 1, 1, 1, 2]
    assert of(100_000, 8) == 2


@pytest.mark.parametrize("kind", ["plain", "ties", "repeats", "huge", "floor"])
def test_a_bucket_meets_all_its_queries_at_once(monkeypatch, kind):
    monkeypatch.setattr(ann, "KEPT", 300)
    monkeypatch.setattr(ann, "SCORES", 64)
    rng, k = np.random.default_rng(6), 5
    v = rng.integers(-2, 3, (200, 4)).astype(float) if kind in ("ties", "repeats") else rng.normal(size=(200, 4))
    v *= 1e140 if kind == "huge" else 1
    ids = rng.permutation(400)[:200] if kind != "repeats" else rng.integers(0, 60, 200)
    codes = np.sort(rng.integers(0, 12, 200)).astype("<u4")
    asks = rng.permutation(200)[:50]
    q, q_ids = v[asks], ids[asks]
    wanted = [np.sort(rng.choice(16, rng.integers(1, 9), replace=False)).astype("<u4") for _ in asks]
    wanted[0] = np.array([14], "<u4")
    floor = np.full(50, -np.inf) if kind != "floor" else rng.normal(size=50)
    rows, found, scores, met = ann.best_in_buckets(q, q_ids, wanted, v, ids, codes, floor, k)
    assert met[0] == 0
    for i in range(50):
        near = np.flatnonzero(np.isin(codes, wanted[i]) & (ids != q_ids[i]))
        assert met[i] == len(near)
        best = {}
        for j, s in zip(ids[near].tolist(), ann._inner(q[i], v[near]).tolist()):
            best[j] = max(best.get(j, -np.inf), s)
        want = [x for x in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] if x[1] >= floor[i] or kind == "repeats"]
        assert sorted(zip(found[rows == i].tolist(), scores[rows == i].tolist()), key=lambda x: (-x[1], x[0])) == want
