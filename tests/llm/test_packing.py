"""Packing: patterns against exhaustive search, rows against plain Python."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiframe.llm import packing as pk
from tests.llm.helpers import clashing, documents, text


def _optimum(lengths, capacity):
    """Fewest bins, by trying every place for each piece, largest first."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[i] <= capacity:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b + lengths[i]])
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def _check(counts, capacity, patterns):
    used = defaultdict(int)
    for p in patterns:
        assert sum(p.lengths) <= capacity and p.times > 0
        for x in p.lengths:
            used[x] += p.times
    assert dict(used) == counts
    return sum(p.times for p in patterns)


@pytest.mark.parametrize("seed", range(40))
def test_small_cases_are_optimal(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
    counts = {x: lengths.count(x) for x in lengths}
    n = _check(counts, 20, pk.complete_bins(counts, 20))
    assert n == _optimum(lengths, 20) >= pk.lower_bound(counts, 20)


@pytest.mark.parametrize("seed", range(30))
def test_twelve_pieces_are_optimal_and_proven(seed):
    """Repeated lengths included: repeat counts are branched on."""
    rnd = random.Random(1000 + seed)
    few = [rnd.randint(2, 14) for _ in range(rnd.randint(2, 8))]
    lengths = [rnd.choice(few) for _ in range(12)]
    counts = {x: lengths.count(x) for x in lengths}
    found = pk.search(counts, 20)
    assert found.proven and _check(counts, 20, found.patterns) == found.sequences == _optimum(lengths, 20)


def test_random_instances_of_sixty_pieces():
    """No instance fails; the search beats best fit on some, never goes below the bound, and says what it proved."""
    better = proven = above = 0
    for seed in range(500):
        rnd = random.Random(seed)
        lengths = [rnd.randint(20, 70) for _ in range(60)]
        counts = {x: lengths.count(x) for x in lengths}
        found = pk.search(counts, 100, steps=20_000)
        assert found.bound <= _check(counts, 100, found.patterns) == found.sequences
        first = sum(p.times for p in pk.best_fit(counts, 100))
        assert found.sequences <= first
        better += found.sequences < first
        proven += found.proven
        above += found.sequences > found.bound
    assert better > 50 and proven > 250 and above < 250, (better, proven, above)


@pytest.mark.parametrize("seed", range(3))
def test_large_counts_are_near_the_bound(seed):
    rnd = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(4096, max(1, int(rnd.lognormvariate(6.5, 1))))] += 1
    n = _check(dict(counts), 4096, pk.complete_bins(dict(counts)))
    assert n <= pk.lower_bound(dict(counts), 4096) * 1.001 + 1


def test_best_fit_is_beaten():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 40 in sequences of 10
    assert _check(counts, 10, pk.complete_bins(counts, 10)) == 4


def test_bad_lengths():
    with pytest.raises(ValueError):
        pk.complete_bins({0: 1})
    assert pk.complete_bins({}) == []


def test_places_are_gapless():
    patterns = pk.complete_bins({7: 5, 3: 11, 2: 4, 1: 3}, 10)
    places = pk.Places(patterns)
    seen = defaultdict(list)
    for x, n in {7: 5, 3: 11, 2: 4, 1: 3}.items():
        s, o = places.find(np.full(n, x), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist()):
            seen[a].append((b, x))
    for cells in seen.values():
        at = 0
        for o, x in sorted(cells):
            assert o == at
            at += x
        assert at <= 10


def test_packed_documents(spark):
    rows = [(1, None), (2, ""), (3, text(3, 6000)), (4, "One two. " * 50), (4, "One two. " * 50), (5, "same"), (6, "same"), (None, "no id")]
    rows += [(10 + i, text(i, i % 300)) for i in range(60)]
    got = pk.packed_rows(clashing(documents(spark, rows)).repartition(4)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want, total = [], 0
    for key, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for i, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((key, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for cells in bins.values():
        assert [o for o, _ in sorted(cells)] == list(itertools.accumulate([0, *[x for _, x in sorted(cells)][:-1]]))
        assert sum(x for _, x in cells) <= 4096
    assert len(bins) == -(-total // 4096)


def test_no_documents(spark):
    assert pk.packed_rows(documents(spark, [])).count() == 0
