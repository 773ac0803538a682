"""Packing of token pieces by bin completion (branch and bound).

Documents are cut into pieces of at most ``capacity`` tokens; only documents
longer than that are cut.  How full sequences are built depends on the number
of pieces of each length alone, so the search runs on that histogram (at most
``capacity`` counts, whatever the size of the corpus) and yields *patterns*:
"so many sequences hold these lengths".  Spark numbers the pieces of each
length and every piece looks its place up in the pattern table, a table
bounded by the capacity and not by the data.

The search (Korf 2002, "bin completion"): the next sequence takes the largest
length left; all its undominated fillings are enumerated, the fullest of a few
first, and each is repeated as often as the counts allow, then once less, down to
once; a branch ends when the waste so far exceeds what the best known packing
allows; packing by best fit decreasing is the first incumbent and completes some
branches.  The search stops at the lower bound or after ``STEPS`` steps, and says
how far the best packing found is from the bound and whether it is proven best.

Defined results: a NULL text is empty (only the end id); equal and NULL ids keep
their own pieces; very long texts are cut, not shortened; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import itertools
import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.ranks import with_offsets
from lexiframe.llm.storage import plus, table, written
from lexiframe.llm.tokens import cached_tokenizer

CAPACITY = 4096
#: Steps of the search (sequences opened, lengths looked at) before the best packing so far is taken.
STEPS = 2_000_000


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that each hold ``lengths`` (largest first)."""

    times: int
    lengths: tuple[int, ...]


class _Counts:
    """Counts of lengths, with the present lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.present = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            del self.present[bisect.bisect_left(self.present, length)]

    def give(self, length: int, k: int) -> None:
        if length not in self.n:
            bisect.insort(self.present, length)
            self.n[length] = 0
        self.n[length] += k

    def below(self, most: int) -> int:
        """Index of the largest present length that is at most ``most``; -1 if none."""
        return bisect.bisect_right(self.present, most) - 1


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the total, or the Martello-Toth bound
    (pieces over ``capacity - a`` share a sequence with none of length ``a`` or more)."""
    total = sum(k * v for k, v in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for a in [x for x in lengths if 2 * x <= capacity]:
        big = sum(v for k, v in counts.items() if k > capacity - a)
        half = [(k, v) for k, v in counts.items() if capacity - a >= k > capacity / 2]
        small = sum(k * v for k, v in counts.items() if a <= k <= capacity / 2)
        room = sum((capacity - k) * v for k, v in half)
        best = max(best, big + sum(v for _, v in half) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, sequence by sequence: the largest length left, then
    the largest that still fits, until none does; repeated as often as it can be."""
    left, out = _Counts(counts), []
    while left.present:
        lengths, room, used = [], capacity, {}
        while True:
            i = left.below(room)
            while i >= 0 and used.get(left.present[i], 0) >= left.n[left.present[i]]:
                i -= 1
            if i < 0:
                break
            x = left.present[i]
            lengths.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
        times = min(left.n[k] // v for k, v in used.items())
        for k, v in used.items():
            left.take(k, v * times)
        out.append(Pattern(times, tuple(lengths)))
    return out


class _Budget:
    """Steps left to the whole search: sequences opened, and lengths looked at."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _dominated(left: _Counts, used: dict[int, int], free: int) -> bool:
    """Whether a length left out fits into ``free``, or there in the place of a smaller one."""
    for x in {0, *used}:
        i = left.below(x + free)
        while i >= 0 and left.present[i] > x:
            if used.get(left.present[i], 0) < left.n[left.present[i]]:
                return True
            i -= 1
    return False


def fillings(left: _Counts, first: int, capacity: int, budget: _Budget):
    """All undominated ways to fill a sequence that holds ``first``, one by one,
    until the budget is spent.

    A filling is dominated if a length left out fits into what it leaves free,
    or fits there in the place of a smaller one that it holds.  ``left`` may change
    between two fillings if it is put back before the next."""

    def go(top: int, free: int, used: dict[int, int]):
        i, any_fit = min(top, left.below(free)), False
        while i >= 0 and budget.spend():
            x = left.present[i]
            most = min(left.n[x] - used.get(x, 0), free // x)
            any_fit |= most > 0
            for m in range(most, 0, -1):
                before = used.get(x, 0)
                used[x] = before + m
                yield from go(i - 1, free - m * x, used)
                used[x] = before
                if not before:
                    del used[x]
            i -= 1
        if not any_fit and budget.left > 0 and not _dominated(left, used, free):
            yield tuple(sorted((x for x, m in used.items() for _ in range(m)), reverse=True))

    yield from go(len(left.present) - 1, capacity - first, {first: 1})


def _fullest_first(ways, some: int = 32):
    """A few fillings at a time, the fullest of these first."""
    while few := list(itertools.islice(ways, some)):
        yield from sorted(few, key=lambda f: (-sum(f), [-x for x in f]))


@dataclass(frozen=True)
class Packing:
    """Patterns, the lower bound, and whether no packing has fewer sequences."""

    patterns: list[Pattern]
    bound: int
    proven: bool

    @property
    def sequences(self) -> int:
        return sum(p.times for p in self.patterns)


def search(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """Bin completion: around the largest length left, every undominated filling is
    tried, and each is repeated as often as it can be, then once less, down to once.
    A branch ends where its waste leaves no room for a better packing than the best
    one so far, or where the same lengths were left before in as few sequences.
    Within the budget of steps the search is exact."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths are between 1 and the capacity")
    number = lambda patterns: sum(p.times for p in patterns)
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    left, path, budget = _Counts(counts), [], _Budget(steps)
    rnd = random.Random(0)
    mark = {x: rnd.getrandbits(128) for x in sorted(left.n)}
    state = sum(mark[x] * n for x, n in left.n.items())  # names the lengths left
    seen: dict[int, int] = {}

    def options():
        """Pairs of a filling and how often it is repeated."""
        for lengths in _fullest_first(fillings(left, left.present[-1], capacity, budget)):
            most = min(left.n[x] // lengths.count(x) for x in set(lengths))
            for times in range(most, 0, -1):
                yield lengths, times

    # depth first without recursion: each entry holds its options, what is applied, its waste and sequences
    stack: list[list] = []
    if number(best) > bound and left.present:
        stack.append([options(), None, 0, 0])
    while stack and number(best) > bound and budget.spend():
        entry = stack[-1]
        if entry[1] is not None:  # undo
            for x in set(entry[1].lengths):
                left.give(x, entry[1].lengths.count(x) * entry[1].times)
            state += sum(mark[x] for x in entry[1].lengths) * entry[1].times
            path.pop()
            entry[1] = None
        option = next(entry[0], None)
        if option is None:
            stack.pop()
            continue
        lengths, times = option
        waste = entry[2] + (capacity - sum(lengths)) * times
        opened = entry[3] + times
        after = state - sum(mark[x] for x in lengths) * times
        if waste > (number(best) - 1) * capacity - total or seen.get(after, opened + 1) <= opened:
            continue
        seen[after] = opened
        for x in set(lengths):
            left.take(x, lengths.count(x) * times)
        state = after
        entry[1] = Pattern(times, lengths)
        path.append(entry[1])
        if not left.present:
            if opened < number(best):
                best = list(path)
            continue
        rest = best_fit(left.n, capacity) if len(seen) % 64 == 1 else None
        if rest is not None and opened + number(rest) < number(best):
            best = [*path, *rest]
        stack.append([options(), None, waste, opened])
    return Packing(best, bound, number(best) == bound or (not stack and budget.left >= 0))


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[Pattern]:
    """The best packing found by bin completion."""
    return search(counts, capacity, steps).patterns


class Places:
    """Sequence and offset of the n-th piece of each length."""

    def __init__(self, patterns: list[Pattern]):
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for p in patterns:
            offset = 0
            for length in sorted(set(p.lengths), reverse=True):
                k = p.lengths.count(length)
                rows.setdefault(length, []).append((taken.get(length, 0), base, k, offset, length))
                taken[length] = taken.get(length, 0) + k * p.times
                offset += k * length
            base += p.times
        self.rows = {k: np.array(v, dtype=np.int64).T for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            first, base, k, start, size = self.rows[int(x)]
            i = np.searchsorted(first, rank[at], side="right") - 1
            nth = rank[at] - first[i]
            sequence[at] = base[i] + nth // k[i]
            offset[at] = start[i] + nth % k[i] * size[i]
        return sequence, offset


PIECES = "id long, piece int, start long, length long, ids binary, part long, local long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int,
                 keeps_space: bool, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its ids (little-endian, 2 bytes each for vocabularies
    up to 65,536 ids, else 4) and its number among the pieces of this length in its part."""

    def cut(batches):
        tok = cached_tokenizer(tokenizer_path, keeps_space)
        end, part, seen = tok.dtype.type(end_id).tobytes(), TaskContext.get().partitionId(), {}
        width = tok.dtype.itemsize
        for batch in batches:
            keys = batch.column("id").to_pylist()
            rows: list[tuple] = []
            size = 0
            for key, raw in zip(keys, tok.encode_column(batch.column("text")), strict=True):
                raw += end
                for i, at in enumerate(range(0, len(raw), capacity * width)):
                    ids = raw[at: at + capacity * width]
                    length = len(ids) // width
                    rows.append((key, i, at // width, length, ids, part, seen.get(length, 0)))
                    seen[length] = seen.get(length, 0) + 1
                size += len(raw)
                if size > 2 << 20:
                    yield _pieces_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _pieces_batch(rows)

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return keyed.mapInArrow(cut, PIECES)


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(pieces: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the (written) pieces.

    The pieces move at most once, joined with the offsets of their part and
    length: a length that many pieces share is spread over its parts."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = Places(complete_bins(counts, capacity, steps))
    ranked = with_offsets(pieces, ["length"], "part", "local", F.lit(1), "rank")

    def find(batches):
        for b in batches:
            sequence, offset = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)],
                                             names=[*b.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(find, plus(ranked.schema, sequence_id="long", offset="long"))


def with_crc(packed: DataFrame, id_bytes: int) -> DataFrame:
    """``ids_crc32``: unsigned crc32 of a piece's ids as 4-byte integers."""
    kind = f"<u{id_bytes}"

    def crc(batches):
        for b in batches:
            crcs = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
            keep = [i for i, n in enumerate(b.schema.names) if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(crcs, pa.int64())],
                                             names=[*[b.schema.names[i] for i in keep], "ids_crc32"])

    return packed.mapInArrow(crc, plus(packed.drop("ids").schema, ids_crc32="long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, keeps_space: bool,
                   capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    pieces = written(token_pieces(docs, "doc_id", "text", tokenizer_path, end_id, keeps_space, capacity), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", "doc_id")


def packed_rows(docs: DataFrame) -> DataFrame:
    """The contract's row per piece for a table of documents."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    packed = pack_documents(docs, path, 1, keeps_space=False)
    return with_crc(packed, cached_tokenizer(path, False).dtype.itemsize).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_bin_completion(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens."""
    return packed_rows(table(spark, sf_dir, "documents"))
