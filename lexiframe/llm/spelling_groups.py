"""Spelling variants by blocked Gram matrices.

The words of a corpus become vectors of letter counts.  Two words that differ by
one inserted, deleted or replaced code point have vectors at a squared distance
of at most two and lengths at most one apart, so only blocks of equal or adjacent
length are multiplied: ``|a|^2 + |b|^2 - 2 a.b`` of a pair of blocks is one NumPy
product.  The pairs at a distance of at most two are then verified code point by
code point.

Blocks are cut finer by the counts of ``GROUPS`` disjoint groups of letters: an
insertion raises one of these counts by one, a replacement moves at most one from
a group to another, so a cell of counts meets itself and its ``GROUPS + GROUPS *
(GROUPS - 1) / 2`` neighbours and no other.  Cells of more than a block are dealt
over blocks by a hash of the word, and each pair of blocks is multiplied in one
place only.  A task holds one pair of blocks and returns one row per word (how many
near words, and the best of them), so a word with many neighbours costs no more.

Defined results: a NULL text holds no words; a NULL id counts as empty text in the
hash that decides on a deletion; repeated rows count again; an empty table gives
no rows; very long words get blocks of few words and very long texts are read
whole; ties of counts go to the smallest word in code-point order; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.storage import table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One damaged run in so many, the shortest words, and the fewest occurrences.
DAMAGE, SHORTEST, RAREST = 97, 5, 3
#: Groups of letters of the cells, words of a block, and code points of a block of long words.
GROUPS, BLOCK, BLOCK_CHARS = 4, 2048, 1 << 20
#: A form is at least this many times as frequent.
FACTOR = 2
#: Counts a task holds before it hands them on.
HELD = 200_000
#: Rows of a product looked at together, and pairs verified together.
ROWS, PAIRS = 512, 1 << 16


def _counts(batches):
    held: Counter = Counter()
    for batch in batches:
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            # bytes.lower() changes A-Z only
            own = Counter(RUN.findall(text.encode().lower().decode()))
            head = crc32(b":" if id_ is None else f"{id_}:".encode())
            for word, n in own.items():
                h = crc32(word.encode(), head)
                if h % DAMAGE == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                if len(word) >= SHORTEST:
                    held[word] += n
        if len(held) > HELD:
            yield _counted(held)
            held.clear()
    if held:
        yield _counted(held)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, n)`` of all runs of letters, the damage done, that are long and frequent enough."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    found = rows.mapInArrow(_counts, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


def letter_group(code: np.ndarray) -> np.ndarray:
    """The group of a code point, in 0 .. GROUPS - 1."""
    return (code * 7 + code // 5) % GROUPS


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and the places where words begin (one more for the end)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return code, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _cells(batches):
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        code, at = _letters(words)
        owner = np.repeat(np.arange(len(words)), np.diff(at))
        sums = np.bincount(owner * GROUPS + letter_group(code), minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        cell = pa.array([",".join(map(str, c)) for c in sums.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), cell, pa.array(np.diff(at), pa.int64())],
                                         names=["word", "n", "cell", "length"])


def _moves() -> list[list[int]]:
    """Steps from a cell to each neighbour that is met once: an insertion (the longer
    cell is the neighbour) or a replacement (letters move to a later group)."""
    unit = np.eye(GROUPS, dtype=int)
    grown = [unit[i] for i in range(GROUPS)]
    moved = [unit[j] - unit[i] for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return [m.tolist() for m in grown + moved]


def block_pairs(celled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with their block, and the pairs of blocks that are multiplied:
    ``(cell, block, unit, side)`` says that a block is a side of a unit."""
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.lit(BLOCK_CHARS) / F.col("length"))).cast("long")
    cells = written(celled.groupBy("cell", "length").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / size).cast("long").alias("blocks")), "cells")
    counts = F.split("cell", ",")
    moves = F.array(*[F.concat_ws(",", *[(counts[i].cast("long") + m[i]).cast("string") for i in range(GROUPS)]) for m in _moves()])
    near = cells.select("cell", "blocks", F.explode(moves).alias("other"))
    met = near.join(cells.select(F.col("cell").alias("other"), F.col("blocks").alias("others")), "other")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    apart = met.select("cell", "other", F.explode(every).alias("i"), "others").select(
        "cell", "other", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("j"))
    inside = cells.select("cell", F.col("cell").alias("other"), F.explode(every).alias("i"), "blocks").select(
        "cell", "other", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    units = written(apart.unionByName(inside).withColumn("unit", F.concat_ws("/", "cell", "i", "other", "j")), "units")
    left = units.select("cell", F.col("i").alias("block"), "unit", F.lit(0).alias("side"))
    same = (F.col("cell") == F.col("other")) & (F.col("i") == F.col("j"))
    right = units.filter(~same).select(F.col("other").alias("cell"), F.col("j").alias("block"), "unit", F.lit(1).alias("side"))
    words = celled.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    return words.select("word", "n", "cell", "block"), left.unionByName(right)


class _Block:
    """Words of one side: their letter counts and code points."""

    def __init__(self, words, n):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], np.array([n[i] for i in order], dtype=np.int64)
        self.code, self.at = _letters(self.words)
        self.width = np.diff(self.at)
        self.longest = int(self.width.max())

    def vectors(self, letters):
        owner = np.repeat(np.arange(len(self.words)), self.width)
        # sums of squares below 2 ** 24 are exact in single precision
        kind = np.float32 if self.longest < 2000 else np.float64
        flat = np.bincount(owner * len(letters) + np.searchsorted(letters, self.code), minlength=len(self.words) * len(letters))
        return flat.reshape(-1, len(letters)).astype(kind)

    def grid(self):
        """Code points, one row per word, filled up with 0 (in a block lengths are equal)."""
        out = np.zeros((len(self.words), self.longest), np.int64)
        inside = np.arange(self.longest) < self.width[:, None]
        out[inside] = self.code
        return out


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ by exactly one edit; the words of
    ``b`` are as long as those of ``a`` or longer by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    length = a.shape[1]
    head = np.cumprod(a == b[:, :length], axis=1).sum(axis=1)
    tail = np.cumprod(a[:, ::-1] == b[:, ::-1][:, :length], axis=1).sum(axis=1)
    return head + tail >= length


def near_pairs(a: _Block, b: _Block):
    """Places of the near pairs of two blocks, ``b`` being as long or longer by one
    (of a block with itself if ``b`` is ``a``: each pair once), a few rows of the
    product at a time."""
    letters = np.unique(np.concatenate([a.code, b.code]))
    va, vb = a.vectors(letters), b.vectors(letters)
    if va.dtype != vb.dtype:
        va, vb = va.astype(np.float64), vb.astype(np.float64)
    ga, gb = a.grid(), b.grid()
    na, nb = (va * va).sum(axis=1), (vb * vb).sum(axis=1)
    pairs = max(1, PAIRS // (1 + max(a.longest, b.longest) // 16))
    for lo in range(0, len(va), ROWS):
        distance = na[lo: lo + ROWS, None] + nb[None, :] - 2 * (va[lo: lo + ROWS] @ vb.T)
        i, j = np.nonzero(distance <= 2)
        i += lo
        if a is b:
            once = i < j
            i, j = i[once], j[once]
        for at in range(0, len(i), pairs):
            x, y = i[at: at + pairs], j[at: at + pairs]
            good = _verified(ga[x], gb[y])
            yield x[good], y[good]


class _Best:
    """Per word of a block: how many near words, and the most frequent of them."""

    def __init__(self, block):
        self.block = block
        self.near = np.zeros(len(block.words), np.int64)
        self.best = np.zeros(len(block.words), np.int64)
        self.word: list[str | None] = [None] * len(block.words)

    def add(self, mine, other, theirs):
        self.near += np.bincount(mine, minlength=len(self.near))
        # words of a block are sorted: among equal counts the smallest place is the smallest word
        order = np.lexsort((theirs, -other.n[theirs], mine))
        first = order[np.r_[True, mine[order][1:] != mine[order][:-1]]] if len(order) else order
        for k in first.tolist():
            w, m, n = int(mine[k]), other.words[theirs[k]], int(other.n[theirs[k]])
            if self.word[w] is None or n > self.best[w] or (n == self.best[w] and m < self.word[w]):
                self.best[w], self.word[w] = n, m

    def rows(self):
        at = np.flatnonzero(self.near)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.block.words[k] for k in at], pa.string()), pa.array(self.near[at]),
             pa.array(self.best[at]), pa.array([self.word[k] for k in at], pa.string())], names=["word", "near", "best_n", "best"])


def multiply(sides: dict[int, tuple[list, list]]):
    """The near words of one unit, as rows per word."""
    a = _Block(*sides[0]) if 0 in sides else None
    b = _Block(*sides[1]) if 1 in sides else None
    if a is None or (b is None and len(a.words) < 2):
        return
    other = b or a
    mine, theirs = _Best(a), _Best(other)
    for x, y in near_pairs(a, other):
        mine.add(x, other, y)
        theirs.add(y, a, x)
    yield mine.rows()
    yield theirs.rows()


def _units(batches):
    """Rows arrive sorted by unit; a unit is two blocks at most."""
    unit, sides = None, {}
    for batch in batches:
        names = batch.column("unit").to_pylist()
        rows = zip(names, batch.column("side").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)
        for name, side, word, n in rows:
            if name != unit:
                if sides.get(0):
                    yield from multiply(sides)
                unit, sides = name, {}
            words, counts = sides.setdefault(side, ([], []))
            words.append(word)
            counts.append(n)
    if sides.get(0):
        yield from multiply(sides)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words with a near word; ``vocabulary``
    is a written table of ``(word, n)``."""
    celled = vocabulary.mapInArrow(_cells, "word string, n long, cell string, length long")
    words, sides = block_pairs(written(celled, "celled"))
    dealt = words.join(sides, ["cell", "block"]).select("unit", "side", "word", "n")
    found = dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(_units, "word string, near long, best_n long, best string")
    # the largest count, then the smallest word
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("t")).select(
        "word", "n_near", (-F.col("t.n")).alias("best_n"), F.col("t.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: forms followed to the last.  Counts
    at least double at each step, so a chain is short and each round halves it."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every word with its near words' number, its form and its root."""
    vocabulary = written(word_counts(docs, id_col, text_col), "vocabulary")
    near = near_words(vocabulary)
    better = F.col("best_n") >= FACTOR * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    joined = written(joined, "forms")
    return joined.join(roots(joined.filter("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_forms(spark, sf_dir):
    """Spelling variants of the words of ``documents``."""
    return group(table(spark, sf_dir, "documents"), "doc_id", "text")
