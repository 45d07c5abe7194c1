"""Searches of the trie for runs of queries."""

import numpy as np
import pytest

from tracewright.llm import ngram
from tracewright.llm.eliasfano import EliasFano


@pytest.mark.parametrize(("n", "top"), [(2, 0), (300, 3), (300, 200), (300, 10**6), (300, 2**62)])
def test_ranges_and_followers(n, top):
    rng = np.random.default_rng(n + top % 97)
    v = np.sort(rng.integers(0, top, n, endpoint=True).astype(np.uint64))
    s = EliasFano(EliasFano.build(v))
    i = rng.integers(0, n - 1, 50)
    assert all((a == b).all() for a, b in zip(s.ranges(i), (v[i], v[i + 1])))
    h = np.arange(0, min(2 * top + 3, 500))
    assert all((a == b).all() for a, b in zip(s._around(h), (np.searchsorted(v >> np.uint64(s.bits), h), np.searchsorted(v >> np.uint64(s.bits), h, side="right"))))
    groups, follower = np.repeat(np.arange(9), 7), np.concatenate([np.sort(rng.choice(50, 7, replace=False)) for _ in range(9)])
    f = EliasFano(ngram.followers(groups, follower))
    of = np.repeat(np.arange(9), 50)
    got = ngram.find_follower(f, np.arange(9) * 7, np.arange(1, 10) * 7, of, np.tile(np.arange(50), 9))
    places = {(g, w): i for i, (g, w) in enumerate(zip(groups.tolist(), follower.tolist()))}
    assert got.tolist() == [places.get((g, w), -1) for g in range(9) for w in range(50)]
