"""Spelling variants against brute force over all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from lexiframe.llm import spelling_groups as sg

from tests.llm.helpers import LOWER, clashing, documents


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def result(docs):
    got = sg.group(docs, "doc_id", "text").select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def corpus(seed, n):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdeéÀÿn") for _ in range(rnd.randrange(3, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(60)):
            w = list(stems[min(int(rnd.expovariate(0.1)), 59)])
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w[at: at + rnd.choice([0, 1])] = rnd.choice(["", "a", "é", "X", "xy"])
            words.append("".join(w).title() if rnd.random() < 0.2 else "".join(w))
        rows.append((i, rnd.choice([" ", "-", "\n", "5"]).join(words)))
    return rows + [(None, "plain plain plain plains"), (None, None), (3, ""), (3, "plains plains"), (9, "ÉCOLE école ÉCOLE ÉCOLE école école")]


@pytest.mark.parametrize("block", [2048, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    """Blocks of three words give the same result as whole cells."""
    monkeypatch.setattr(sg, "BLOCK", block)
    rows = corpus(block, 250)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)
    assert result(clashing(documents(spark, rows))) == want


def test_damaged_runs_are_counted_as_damaged(spark):
    rows = [(i, "cathedral window") for i in range(2000)]
    got = result(documents(spark, rows))
    assert got == brute(rows)
    assert any(r[0] != "cathedral" and r[2] == "cathedral" for r in got)


def test_long_words_long_texts_and_empty_table(spark):
    long = "ab" * 4000
    rows = [(i, " ".join([long, long[:-1], long + "x", "q" + long[1:]])) for i in range(4)] + [(9, "lorem ipsum " * 100_000)]
    assert result(documents(spark, rows)) == brute(rows)
    assert result(documents(spark, [])) == set()
    assert result(documents(spark, [(1, "one two")])) == set()


def test_distances_of_cells_cover_every_edit():
    """Every edit leads to the same cell or along one of the moves."""
    rnd = random.Random(2)
    moves = {tuple(m) for m in sg._moves()}

    def cell(w):
        code, _ = sg._letters([w])
        g = sg.letter_group(code)
        return tuple((g == i).sum() for i in range(sg.GROUPS))

    for _ in range(2000):
        w = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéàÿÀ×") for _ in range(rnd.randrange(5, 12)))
        at, x = rnd.randrange(len(w)), rnd.choice("abcxyzéÿ")
        for v in (w[:at] + x + w[at:], w[:at] + x + w[at + 1:]):
            step = tuple(b - a for a, b in zip(cell(w), cell(v), strict=True))
            assert not any(step) or step in moves or tuple(-s for s in step) in moves
