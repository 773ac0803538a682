"""Jaccard groups, components and passages against brute force."""

import random

import numpy as np
import pytest

from lexiframe.llm import compact_windows as cw
from lexiframe.llm import jaccard_groups as jg
from lexiframe.llm.graph import components
from tests.llm.helpers import WORD, clashing, documents, saved, shingle_set, text, words


def _roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components(spark, kind):
    rnd = random.Random(2)
    edges = {"random": [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)], "chain": [(i, i + 1) for i in range(70)],
             "star": [(50, i) for i in range(100)], "loops": [(3, 3), (5, 4), (4, 5), (9, 9)]}[kind]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.label for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in edges if a != b]
    want = _roots({x for e in real for x in e}, real)
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _corpus():
    rnd = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "solo"), (8, "a b c"), (9, "A B c\n")]
    common = ["of", "the", "and"]
    for i in range(40):
        w = [rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(300)}" for _ in range(rnd.randint(20, 160))]
        rows.append((100 + i, " ".join(w)))
    base = words(rnd, 200)
    for i in range(60):  # a group of near copies around the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10_000)}"
        rows.append((300 + i, " ".join(w[: rnd.randint(180, 200)])))
    for i in range(12):  # growing texts: neighbours link, ends do not
        rows.append((500 + i, " ".join(base[:5] + [f"g{j}" for j in range(60 + 4 * i)])))
    rows += [(700 + i, text(1, 90)) for i in range(30)]  # equal copies
    return rows


def _wanted(rows, near=lambda a, b: 100 * len(a & b) >= 90 * len(a | b)):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and near(sets[a], sets[b])]
    return sets, _roots(ids, edges)


@pytest.mark.parametrize("parts", [1, 7])
def test_jaccard_groups_equal_brute_force(spark, tmp_dir, monkeypatch, parts):
    monkeypatch.setattr(jg, "TIE_ROWS", 500)
    rows = _corpus()
    got = jg.op6_jaccard_groups(spark, saved(clashing(documents(spark, rows)).repartition(parts), tmp_dir)).collect()
    sets, roots = _wanted(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), roots[i]) for i in sets}


def test_links_that_only_the_matrix_finds(spark, monkeypatch):
    """Groups that the strongest ties leave apart are joined when they are opened."""
    monkeypatch.setattr(jg, "strongest", lambda ties: ties.select("node", "to").limit(0))
    rows = _corpus()
    got = jg.jaccard_components(documents(spark, rows), "doc_id", "text").collect()
    sets, roots = _wanted(rows)
    assert {r.id: r.component_id for r in got} == roots


def test_jaccard_edges(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "x y"), (2, "x y")]
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jg.jaccard_components(documents(spark, rows), "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (4, 2, 4), (4, 2, 4), (9, 1, 2), (2, 1, 2)], key=str)
    assert jg.jaccard_components(documents(spark, []), "doc_id", "text").count() == 0
    kept = jg.one_per_group(spark, clashing(documents(spark, rows)), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "None", "None"]
    assert kept.columns == clashing(documents(spark, rows)).columns


def test_one_row_of_each_group_by_row_not_by_id(spark):
    """Rows that share an id but not their text are judged apart; equal rows are one."""
    near = text(70, 60)
    rows = [(1, near), (7, near + " more"), (7, text(71, 60)), (7, text(71, 60)), (8, None), (8, ""), (8, text(72, 30)), (None, near), (9, text(72, 30)), (3, "a b")]
    kept = jg.one_per_group(spark, documents(spark, rows), "")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, near), (7, text(71, 60)), (8, None), (8, ""), (8, text(72, 30)), (None, near), (3, "a b")], key=str)


# ---- passages


def test_windows_equal_the_definition():
    rng = np.random.default_rng(4)
    lengths = [30, 46, 47, 300, 5, 120]
    sh = rng.integers(0, 2 ** 63, sum(lengths)).astype(np.uint64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    bits = int(len(sh)).bit_length()
    for i, (_, _, _, c, left, right) in enumerate(cw.compact_windows(sh, doc)):
        key = (cw.mix(sh ^ cw._SEEDS[i]) & ~np.uint64((1 << bits) - 1)) | np.arange(len(sh), dtype=np.uint64)
        want = []
        for p in range(len(sh)):
            lo = hi = p
            while lo > 0 and doc[lo - 1] == doc[p] and key[lo - 1] > key[p]:
                lo -= 1
            while hi + 1 < len(sh) and doc[hi + 1] == doc[p] and key[hi + 1] > key[p]:
                hi += 1
            if hi - lo + 1 >= cw.WIDTH:
                want.append((p, lo, hi))
        assert list(zip(c.tolist(), left.tolist(), right.tolist())) == want


def _passage_corpus():
    rnd = random.Random(21)
    shared = [words(rnd, n) for n in (51, 60, 90, 200)]
    short = words(rnd, 30)
    rows, planted = [], {}
    for i in range(80):
        w = words(rnd, rnd.randint(0, 200))
        if i % 4 == 0:
            p = i // 4 % 4
            at = rnd.randint(0, len(w))
            planted.setdefault(p, []).append((i, at, at + len(shared[p])))
            w[at:at] = shared[p]
        if i % 3 == 0:
            at = rnd.randint(0, len(w))
            if i not in {x for v in planted.values() for x, _, _ in v}:
                w[at:at] = short
        rows.append((i, " ".join(w)))
    near = list(shared[2])
    near[45] = "edited"
    rows.append((90, " ".join(words(rnd, 40) + near + words(rnd, 40))))
    rows += [(91, None), (92, ""), (93, "few words"), (None, " ".join(shared[0])), (94, text(9, 300)), (95, text(9, 300)), (95, text(9, 300))]
    return rows, shared, planted


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_passages_are_found(spark, tmp_dir, monkeypatch, parts):
    monkeypatch.setattr(cw, "TIE_ROWS", 2000)
    rows, shared, planted = _passage_corpus()
    got = cw.op4_compact_windows(spark, saved(clashing(documents(spark, rows)).repartition(parts), tmp_dir)).collect()
    text_of = {i: WORD.findall(t or "") for i, t in rows if i is not None}
    cover = {}
    for r in got:
        assert r.first_doc_id < r.doc_id and r.end_word - r.start_word >= 50 and r.jaccard >= 0.8
        a = shingle_set(" ".join(text_of[r.doc_id][r.start_word:r.end_word]), 5)
        b = shingle_set(" ".join(text_of[r.first_doc_id][r.first_start_word:r.first_end_word]), 5)
        assert len(a & b) >= 0.8 * len(a | b)
        cover.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for places in planted.values():
        for i, lo, hi in places[1:]:
            assert any(a <= lo and hi <= b for a, b in cover.get(i, [])), (i, lo, hi)
    assert 90 in cover and 95 in cover
    clean = set(text_of) - {i for v in planted.values() for i, _, _ in v} - {90, 94, 95}
    assert not clean & (set(cover) | {r.first_doc_id for r in got})


def test_stage_cuts_all_but_the_first(spark):
    rows, shared, planted = _passage_corpus()
    docs = clashing(documents(spark, rows))
    out = cw.without_repeats(spark, docs, "")
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    for p, places in planted.items():
        whole = " ".join(shared[p])
        assert whole in left[places[0][0]].text
        for i, lo, hi in places[1:]:
            got = WORD.findall(left[i].text)
            assert got == WORD.findall(rows[i][1])[:lo] + WORD.findall(rows[i][1])[hi:]
            assert left[i].n_chars == len(left[i].text)
    assert 95 not in left and left[94].text == rows[-3][1] and left[91].text is None and left[93].text == "few words"
    untouched = {i for i, _ in rows if i is not None} - {x for v in planted.values() for x, _, _ in v} - {90, 95}
    assert all(left[i].text == dict(rows)[i] for i in untouched)
    assert cw.repeated_passages(documents(spark, [])).count() == 0


def test_passages_of_sequences():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    y = np.concatenate([rng.integers(0, 2 ** 63, 40).astype(np.uint64), x[100:180], rng.integers(0, 2 ** 63, 9).astype(np.uint64)])
    assert cw.passages(x, y) == [(100, 184, 40, 124, 1.0)]
    assert cw.passages(x[:45], x[:45]) == [] and len(cw.passages(x[:46], x[:46])) == 1
    assert cw.passages(np.zeros(60, np.uint64), np.zeros(60, np.uint64))


def test_ties_of_a_key_beyond_a_block(spark, monkeypatch):
    """The order of contexts is not that of documents; blocks change nothing."""
    rnd = random.Random(5)
    rows = [(key, d, rnd.randrange(40) << 32 | rnd.randrange(90), 60 << 16 | 60, rnd.randrange(40), *[None] * 9)
            for key in (3, 8, 9) for d in range(400 if key == 8 else 3) for _ in range(1 + d % 2)]
    df = spark.createDataFrame(rows, f"{cw.ROWS}, {cw.TIES}").repartition(3)
    whole = sorted(map(tuple, cw.all_ties(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        monkeypatch.setattr(cw, "TIE_ROWS", 50)
        assert sorted(map(tuple, cw.all_ties(df).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {a for a, b, *_ in whole if b == 0} >= set(range(1, 400))  # all tied to the key's earliest document


def _brute_cover(x, y):
    """Shared shingles of x inside a pair of stretches of ``WIDTH`` shingles or more, ends shared, with enough Jaccard."""
    at = {v: j for j, v in enumerate(y)}
    hits = [(i, at[v]) for i, v in enumerate(x) if v in at]
    out = set()
    for s in range(len(hits)):
        for e in range(len(hits) - 1, s, -1):
            (i, k), (j, n) = hits[s], hits[e]
            if n <= k:
                continue
            p, q = set(x[i: j + 1]), set(y[k: n + 1])
            if j - i + 1 >= cw.WIDTH and n - k + 1 >= cw.WIDTH and 100 * len(p & q) >= cw.PERCENT * len(p | q):
                out |= {h for h, _ in hits[s: e + 1]}
                break
    return out


def _shingles_of(*texts):
    number = {}
    return [np.array([number.setdefault(tuple(w[i: i + 5]), len(number)) for i in range(len(w) - 4)], np.uint64) for w in texts]


def _edited(rnd, w, n, size):
    w = list(w)
    for _ in range(n):
        at = rnd.randrange(len(w))
        w[at: at + rnd.randint(0, size)] = words(rnd, rnd.randint(0, size))
    return w


@pytest.mark.parametrize("seed", range(30))
def test_passages_equal_brute_force(seed):
    rnd = random.Random(seed)
    w = words(rnd, rnd.randint(60, 220))
    x, y = _shingles_of(words(rnd, 30) + _edited(rnd, w, rnd.randint(1, 9), 12) + words(rnd, 30), words(rnd, 20) + w + words(rnd, 40))
    got = cw.passages(x, y)
    covered = {i for a, b, _, _, _ in got for i in range(a, b - 4)}
    assert _brute_cover(x.tolist(), y.tolist()) <= covered
    for a, b, c, d, j in got:
        p, q = set(x[a: b - 4].tolist()), set(y[c: d - 4].tolist())
        assert b - a >= 50 and d - c >= 50 and j == len(p & q) / len(p | q) >= 0.8


def test_passages_with_clustered_edits():
    rnd = random.Random(1)
    w = words(rnd, 95)
    x, y = _shingles_of(w[:45] + words(rnd, 6) + w[51:], w)  # a gap in the middle: 81 of 101
    assert [r[:4] for r in cw.passages(x, y)] == [(0, 95, 0, 95)]
    loose = words(rnd, 100)
    near = [v if i % 8 else f"other{i}" for i, v in enumerate(loose)]
    v = words(rnd, 99)
    x, y = _shingles_of(v[:49] + ["edit"] + v[50:] + near, v + loose)  # next to 100 words that are less similar
    assert any(a == 0 and b >= 99 for a, b, *_ in cw.passages(x, y))
    line = ["so", "it", "goes", "on", "and", "on"]
    p = words(rnd, 400) + line + words(rnd, 60)
    x, y = _shingles_of(words(rnd, 9) + p, line + p[:400] + words(rnd, 70) + p)  # most shingles twice, far from the first place
    assert any(a == 9 and b == 475 for a, b, *_ in cw.passages(x, y))
    short = words(rnd, 45)
    x, y = _shingles_of(short + words(rnd, 5), short + words(rnd, 5))  # 41 of 51 shingles
    assert [r[:2] for r in cw.passages(x, y)] == [(0, 50)]


def test_passages_with_repeated_shingles():
    rnd = random.Random(3)
    line = words(rnd, 8)
    w = words(rnd, 30) + line * 3 + words(rnd, 40)
    x, y = _shingles_of(words(rnd, 70) + w[:50] + words(rnd, 3) + w[50:] + line * 20, w + words(rnd, 60))
    assert any(a <= 70 and b >= 70 + len(w) + 3 for a, b, *_ in cw.passages(x, y))


def test_equal_passages_of_frequent_phrases(spark):
    """Pieces of the passages stand in many earlier documents; brute force over all windows."""
    rnd = random.Random(8)
    rows = []
    shared = [words(rnd, 50 + 4 * (i % 3)) for i in range(12)]
    for p in shared:
        for _ in range(40):
            at, n = rnd.randrange(0, 40), rnd.choice((8, 15, 30, 45))
            rows.append(words(rnd, 60) + p[at: at + n] + words(rnd, 60))
    rnd.shuffle(rows)
    for _ in range(3):
        rows += [words(rnd, rnd.randint(30, 90)) + p + words(rnd, rnd.randint(30, 90)) for p in shared]
    got = cw.repeated_passages(documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)]).repartition(4)).collect()
    covered = {(r.doc_id, k) for r in got for k in range(r.start_word, r.end_word)}
    seen, missed = set(), []
    for i, w in enumerate(rows):
        here = [tuple(w[k: k + 50]) for k in range(len(w) - 49)]
        missed += [(i, k) for k, t in enumerate(here) if t in seen and any((i, j) not in covered for j in range(k, k + 50))]
        seen |= set(here)
    assert not missed, len(missed)
    for r in got:
        if r.jaccard == 1.0:
            assert rows[r.doc_id][r.start_word: r.end_word] == rows[r.first_doc_id][r.first_start_word: r.first_end_word]


def test_stretch_hashes_follow_the_words():
    rng = np.random.default_rng(2)
    sh = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
    for size in (1, 2, 3, 23, 46):
        whole, part = cw.spans(sh, size), cw.spans(sh[50:150], size)
        assert len(whole) == 201 - size and len(np.unique(whole)) == len(whole) and (whole[50: 151 - size] == part).all()
