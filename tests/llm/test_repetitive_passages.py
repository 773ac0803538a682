"""Texts that say the same few things again and again: the search for stretches stays short."""

import time

import numpy as np

from lexiframe.llm import compact_windows as cw


def stretches(m):
    """A chain of ``m`` matches of ten shingles in a row; in the other text none counts as said before."""
    x = np.arange(m, dtype=np.uint64) % 10
    at = np.arange(m)
    return cw._stretches(x, x, at, at, (cw._earlier(x), np.full(m, -1)))


def test_short_chains_are_kept_once_per_place():
    spans = stretches(300)
    least, done = -(-2 * cw.PERCENT * cw.WIDTH // (100 + cw.PERCENT)), []
    for n in range(least, cw.WIDTH):  # every chain of n matches that no stretch before holds
        for i in range(300 - n + 1):
            if not any(x0 <= i and i + n - 1 <= x1 for x0, x1, _, _ in done):
                x0 = min(i, 300 - cw.WIDTH)
                done.append((x0, x0 + cw.WIDTH - 1, x0, x0 + cw.WIDTH - 1))
    assert spans == done and len(spans) > 20


def test_long_repetitive_chains_take_a_moment():
    begin = time.perf_counter()
    assert len(stretches(10_000)) > 1_000
    assert time.perf_counter() - begin < 5


def test_short_dead_ends_are_not_built():
    # one long run, and single matches that no chain can use
    p = np.concatenate([np.arange(60), np.arange(100, 4100, 20)])
    q = np.concatenate([np.arange(60), np.arange(9000, 5000, -20)])
    assert [len(c) for c in cw._chains(p, q, False)] == [60]
