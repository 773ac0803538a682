"""Near-duplicate passages by compact windows (Feng and Deng 2021; Peng et al. 2023).

A text is its sequence of hashed 5-word shingles.  Under each of ``HASHES``
hash functions, the subsequences whose minimum lies at one place form a compact
window (l, c, r): the subtree of c in the Cartesian tree of the hashes.  Only
windows of at least ``MIN_WORDS`` words matter, about 2 / (t + 1) per shingle.

1. Windows with the same minimum are grouped by its hash.  Each is also given
   the minima of two other functions around c, its contexts.  A window is tied
   to the earliest document of its group and, where these differ, to the
   earliest one that agrees in either context, too.
   Groups are tied inside each task before the shuffle, so a passage that a
   third of all documents hold is one row per task and hash there.
2. Interval join: ties of one pair of documents whose windows overlap by at
   least ``MIN_WORDS`` words on both sides are joined; a region counts when two
   or more hashes agree there.  For each place of a document the region with
   most hashes comes first, the others are held back.
3. Regions are verified on the words: stretches of at least ``MIN_WORDS`` words
   whose 5-word shingles have a Jaccard similarity of ``PERCENT`` or more.
   Regions that were held back are verified where no passage was found yet.

4. What steps 1 to 3 leave of equal passages is found by whole windows.  Every
   window of ``MIN_WORDS`` words chooses one of its parts of ``PART`` shingles by
   its words alone, so equal windows choose equal parts.  Windows that are in no
   passage yet and whose part an earlier document holds, too, are keyed by all
   their words, with all windows of the same parts, and tied to the earliest.

A row of the result is a verified pair of passages, the later document (larger
id) first: every repeat is tied to an earlier one, not to all others.  All equal
passages are found; one with edits is missed if the hashes of step 1 fail to
agree, which takes other, earlier texts with the same minima and different
surroundings under nearly all functions at once.

Defined results: NULL or short texts and NULL ids have no passages; rows that
share an id are one document and not compared; equal documents are one passage;
repeats inside one document do not count; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.kernels import U64, blocks, mix, shingle_lists, shingles, string_buffers, words_of
from lexiframe.llm.presence import split_by
from lexiframe.llm.storage import plus, release, table, written
from lexiframe.llm.worker_memory import frugal, gathered, give_back

SHINGLE, MIN_WORDS, PERCENT = 5, 50, 80
#: Hash functions, at most 8 (a function's number sits in the low bits of its hashes).
HASHES = 6
WIDTH = MIN_WORDS - SHINGLE + 1
#: Shingles of the part by which equal windows are first compared.
PART = WIDTH // 2
#: Windows tied together before they leave a task.
TIE_ROWS = 1_500_000
#: Rows handed to Spark at once: a batch is held by both sides.
SLICE = 1 << 16
#: Shingles that edits may interrupt a run by (two neighbouring words); beyond, stretches are searched.
GAP = 2 * SHINGLE
_SEEDS = mix(np.arange(1, 9, dtype=U64) * U64(0xA0761D6478BD642F))
_REACH = (1 << 16) - 1


def nearest_smaller(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place of the nearest smaller one before and after it
    in its group (-1 and ``len``: none), by following pointers over larger ones."""
    n = len(key)
    out = []
    for k, g in ((key, group), (key[::-1], group[::-1])):
        prev = np.arange(n) - 1
        prev[np.append(True, g[1:] != g[:-1])] = -1
        live = np.flatnonzero(prev >= 0)
        while len(live):
            live = live[k[prev[live]] > k[live]]
            prev[live] = prev[prev[live]]
            live = live[prev[live] >= 0]
        out.append(prev)
    after = n - 1 - out[1][::-1]
    return out[0], after


def sliding_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` elements."""
    m, have = key, 1
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have:]) if width > have else m


def compact_windows(sh: np.ndarray, doc: np.ndarray):
    """Windows of at least ``WIDTH`` shingles for every hash function.

    ``sh``: shingle hashes, document after document; ``doc``: their documents.
    Yields ``(hash, context, place of c, l, r)`` with places in ``sh``."""
    n = len(sh)
    if n < WIDTH:
        return
    bits = max(int(n).bit_length(), 1)
    low = U64((1 << bits) - 1)
    place = np.arange(n, dtype=U64)
    inside = doc[: n - WIDTH + 1] == doc[WIDTH - 1:]  # windows within one document
    if not inside.any():
        return
    first = np.searchsorted(doc, doc)  # of each shingle's document
    last = np.searchsorted(doc, doc, side="right") - 1
    values = [mix(sh ^ _SEEDS[i]) for i in range(HASHES)]
    keys = [(v & ~low) | place for v in values]
    minima = [sliding_minimum(k, WIDTH) for k in keys]
    for i in range(HASHES):
        c = (minima[i][inside] & low).astype(np.int64)
        c = c[np.append(True, c[1:] != c[:-1])]
        c = np.unique(c)
        before, after = nearest_smaller(keys[i][c], doc[c])
        left = np.where(before >= 0, c[before] + 1, first[c])
        right = np.where(after < len(c), c[np.minimum(after, len(c) - 1)] - 1, last[c])
        around = np.clip(c - WIDTH // 2, first[c], last[c] - WIDTH + 1)
        one, two = ((values[o][(minima[o][around] & low).astype(np.int64)] >> U64(33)).astype(np.int64)
                    for o in ((i + 1) % HASHES, (i + 2) % HASHES))
        yield (values[i][c] & ~U64(7)) | U64(i), one, two, c, left, right


#: place: first context * 2**32 + c; reach: left * 2**16 + right; second: second context.
ROWS = "key long, doc long, place long, reach int, second int"
TIES = "a long, b long, ac int, bc int, al int, ar int, bl int, br int, mark int"


def _heads(key, context):
    """For sorted rows: which begin a (key, context), and each row's beginning."""
    new = np.append(True, (key[1:] != key[:-1]) | (context[1:] != context[:-1]))
    heads = np.flatnonzero(new)
    return new, heads[np.cumsum(new) - 1]


def _ties(key, doc, place, reach, second, known=0):
    """Ties of rows sorted by key, document and place, and the rows that are the
    first of their key and a context.  The first ``known`` rows are such rows of
    blocks before: others are tied to them, their own ties are known."""
    new = np.append(True, key[1:] != key[:-1])
    alone = new & np.append(new[1:], True)
    shared = np.flatnonzero(~alone)  # most keys have one row, which is its own head
    ties, heads = _shared_ties(*[c[shared] for c in (key, doc, place, reach, second)], int(np.searchsorted(shared, known)))
    return ties, np.sort(np.concatenate([np.flatnonzero(alone), shared[heads]]))


def _shared_ties(key, doc, place, reach, second, known):
    rows = np.arange(len(key))
    if not len(rows):
        return pa.RecordBatch.from_pylist([], schema=pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.int32()) for f in TIES.split(", ")])), rows

    def firsts(context):
        order = np.lexsort((context, key))  # stable: by document and place within a context
        begins, first = _heads(key[order], context[order])
        out = np.empty_like(rows)
        out[order] = order[first]
        return order[begins], out

    _, earliest = _heads(key, key)
    begins, head = firsts(place >> 32)
    begins_second, other = firsts(second)
    heads = np.union1d(begins, begins_second)
    far = [doc[earliest] != doc, (doc[head] != doc) & (doc[head] != doc[earliest]),
           (doc[other] != doc) & (doc[other] != doc[earliest]) & (doc[other] != doc[head])]
    far = [f & (rows >= known) for f in far]
    a = np.concatenate([rows[f] for f in far])
    b = np.concatenate([t[f] for t, f in zip((earliest, head, other), far, strict=True)])
    agree = ((place[a] >> 32) == (place[b] >> 32)) | (second[a] == second[b])
    mark = (1 << (key[a].view(np.uint64) & U64(7)).astype(np.int32)) | (agree.astype(np.int32) << 8)
    at = (place & 0xFFFFFFFF).astype(np.int32)
    ties = pa.RecordBatch.from_arrays(
        [pa.array(doc[a]), pa.array(doc[b]), pa.array(at[a]), pa.array(at[b]),
         *[pa.array(x.astype(np.int32)) for x in (reach[a] >> 16 & _REACH, reach[a] & _REACH, reach[b] >> 16 & _REACH, reach[b] & _REACH)],
         pa.array(mark.astype(np.int32))], names=[f.split()[0] for f in TIES.split(", ")])
    return ties, heads


def window_rows(docs: DataFrame) -> DataFrame:
    """Rows for the shuffle by key, and (key NULL) ties found inside the task,
    in one table: ``ROWS`` plus ``TIES``."""
    names = [f.split()[0] for f in f"{ROWS}, {TIES}".split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 7]

    def padded(n, **given):
        return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)], names=names)

    def build(batches):
        held, rows = [], 0

        def flush():
            cols = gathered(held)
            order = np.argsort(cols[0], kind="stable")
            for i, c in enumerate(cols):
                cols[i] = c[order]
            del order, c
            new = np.append(True, cols[0][1:] != cols[0][:-1])
            shared = np.flatnonzero(~(new & np.append(new[1:], True)))
            finer = [c[shared] for c in cols]
            order = np.lexsort((finer[2] & 0xFFFFFFFF, finer[1], finer[0]))
            for c, f in zip(cols, finer, strict=True):
                c[shared] = f[order]
            del finer, f, order, new, shared
            ties, heads = _ties(*cols)
            give_back()
            for lo in range(0, len(heads), SLICE):
                some = heads[lo: lo + SLICE]
                yield padded(len(some), **{x: pa.array(c[some]) for x, c in zip(names, cols, strict=False)})
            for lo in range(0, ties.num_rows, SLICE):
                part = ties.slice(lo, SLICE)
                yield padded(part.num_rows, **dict(zip(part.schema.names, part.columns, strict=True)))

        for batch in batches:
            ids = batch.column("id").to_numpy()
            raw, offsets = string_buffers(batch.column("text"))
            for lo, hi in blocks(offsets):
                w = words_of(raw, offsets, lo, hi, lower=True)
                sh, at = shingles(w, SHINGLE)
                doc = w.doc[at]
                start = np.searchsorted(doc, np.arange(hi - lo))
                for h, one, two, c, left, right in compact_windows(sh, doc):
                    place = (one << 32) | (c - start[doc[c]])
                    reach = (np.minimum(c - left, _REACH) << 16 | np.minimum(right - c, _REACH)).astype(np.uint32).view(np.int32)
                    held.append((h.view(np.int64), ids[lo:hi][doc[c]], place, reach, two.astype(np.int32)))
                    rows += len(c)
                if rows >= TIE_ROWS:
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()

    return docs.mapInArrow(frugal(build), f"{ROWS}, {TIES}")


def all_ties(rows: DataFrame) -> DataFrame:
    """Ties inside tasks and over all tasks.  Both kinds of rows share one
    shuffle: heads go by key, found ties by their pair.  A key's rows come by
    document, so its earliest document is in the first block; a key of more than
    ``TIE_ROWS`` rows is tied block by block, and the first row of each of its
    contexts goes on to the next block, which gives the ties of one block."""
    deal = F.coalesce(F.col("key"), F.xxhash64("a", "b"))
    dealt = rows.withColumn("_deal", deal).repartition("_deal").drop("_deal")
    dealt = dealt.withColumn("_c", F.col("place").bitwiseAND(0xFFFFFFFF)).sortWithinPartitions("key", "doc", "_c").drop("_c")
    tie_names = [f.split()[0] for f in TIES.split(", ")]

    def sliced(found):
        for lo in range(0, found.num_rows, SLICE):
            yield found.slice(lo, SLICE)

    def tie(batches):
        held, rows, known = [], 0, 0  # rows of one key not yet tied, after its known heads
        for batch in batches:
            old = batch.column("key").null_count
            if old:  # nulls sort first: ties that are known
                yield batch.filter(pc.is_null(batch.column("key"))).select(tie_names)
                batch = batch.filter(pc.is_valid(batch.column("key")))
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy() for c in ("key", "doc", "place", "reach", "second")])
            rows += batch.num_rows
            last = held[-1][0][-1]
            if held[0][0][0] == last and rows - known <= TIE_ROWS:
                continue
            cols = [np.concatenate(p) for p in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], last))
            if cut:
                found, _ = _ties(*[c[:cut] for c in cols], known)
                held, known = [[c[cut:] for c in cols]], 0
            else:  # one key beyond a block: the heads of all its contexts go on
                found, heads = _ties(*cols, known)
                held, known = [[c[heads] for c in cols]], len(heads)
            rows = len(held[0][0])
            yield from sliced(found)
        if held:
            found, _ = _ties(*[np.concatenate(p) for p in zip(*held, strict=True)], known)
            yield from sliced(found)

    return dealt.mapInArrow(frugal(tie), TIES)


REGIONS = "a long, b long, a_lo int, a_hi int, b_lo int, b_hi int, core_lo int, core_hi int, held boolean"


def _join_intervals(c: dict[str, np.ndarray]):
    """Regions of ties sorted by pair and distance: sets of one pair at like
    distance whose windows overlap by ``WIDTH`` shingles or more, with two
    hashes or more.  The core of a region is the stretch of its minima."""
    n = len(c["a"])
    shift = c["ac"] - c["bc"]
    apart = np.ones(n, dtype=bool)
    apart[1:] = (c["a"][1:] != c["a"][:-1]) | (c["b"][1:] != c["b"][:-1]) | (shift[1:] - shift[:-1] > GAP)
    chain = np.cumsum(apart)
    order = np.lexsort((c["ac"] - c["al"], chain))
    c, chain = {k: v[order] for k, v in c.items()}, chain[order]
    a0, a1 = (c["ac"] - c["al"]).astype(np.int64), (c["ac"] + c["ar"]).astype(np.int64)
    b0, b1 = c["bc"] - c["bl"], c["bc"] + c["br"]
    # sweep: the end reached so far in this chain
    lift = chain * (int(a1.max()) + 1)
    reached = np.maximum.accumulate(a1 + lift) - lift
    begin = np.ones(n, dtype=bool)
    begin[1:] = (chain[1:] != chain[:-1]) | (reached[:-1] - a0[1:] + 1 < WIDTH)
    at = np.flatnonzero(begin)
    marks = np.bitwise_or.reduceat(c["mark"], at)
    hashes = np.zeros(len(at), dtype=np.int64)
    for i in range(9):  # distinct functions, and one more where the context agrees
        hashes += marks >> i & 1
    low = lambda x: np.minimum.reduceat(x, at)
    high = lambda x: np.maximum.reduceat(x, at)
    keep = hashes >= 2
    out = [x[keep] for x in (c["a"][at], c["b"][at], low(a0), high(a1) + SHINGLE, low(b0), high(b1) + SHINGLE,  # in words, ends excluded
                             low(c["ac"]), high(c["ac"]) + SHINGLE)]
    doc, lo, hi = out[0], out[6], out[7]
    held = np.zeros(len(doc), dtype=bool)
    order = np.lexsort((out[1], -np.add.reduceat(np.ones(n, np.int64), at)[keep], -hashes[keep], doc))
    taken: list[tuple[int, int]] = []
    last = None
    for i in order.tolist():
        if doc[i] != last:
            last, taken = doc[i], []
        held[i] = any(x - SHINGLE <= lo[i] and hi[i] <= y + SHINGLE for x, y in taken)
        if not held[i]:
            taken.append((int(lo[i]), int(hi[i])))
    return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64 if i < 2 else np.int32)) for i, x in enumerate(out)], pa.array(held)],
                                      names=[f.split()[0] for f in REGIONS.split(", ")])


def regions(ties: DataFrame) -> DataFrame:
    """Interval join of the ties of each document, pair by pair.  A document
    has at most three ties per window, so its ties fit one task."""
    dealt = ties.repartition("a").withColumn("_shift", F.col("ac") - F.col("bc")).sortWithinPartitions("a", "b", "_shift", "ac").drop("_shift")
    names = [f.split()[0] for f in TIES.split(", ")]

    def join(batches):
        rest = None
        for batch in batches:
            cols = {x: batch.column(x).to_numpy() for x in names}
            if rest is not None:
                cols = {x: np.concatenate([rest[x], cols[x]]) for x in names}
            other = np.flatnonzero(cols["a"] != cols["a"][-1]) if len(cols["a"]) else np.zeros(0, np.int64)
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield _join_intervals({x: v[:cut] for x, v in cols.items()})
            rest = {x: v[cut:] for x, v in cols.items()}
        if rest is not None and len(rest["a"]):
            yield _join_intervals(rest)

    found = dealt.mapInArrow(frugal(join), REGIONS)
    return found.withColumn("region", F.xxhash64("a", "b", "a_lo", "a_hi", "b_lo", "b_hi"))


def slices(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Both sides of every region with their words: ``(region, side, lo, words)``.
    Only texts that may hold a region move."""
    docs, _ = split_by(docs, F.col("id"), found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    side = lambda x, s: F.struct(F.col(x).alias("id"), F.lit(s).alias("side"), F.col(f"{x}_lo").alias("lo"), F.col(f"{x}_hi").alias("hi"))
    needed = found.select("region", F.explode(F.array(side("a", 0), side("b", 1))).alias("s")).select("region", "s.*")
    joined = docs.join(needed, "id").select("region", "side", "lo", "hi", "text")

    def cut(batches):
        for batch in batches:
            out = {x: [] for x in ("region", "side", "lo", "words")}
            region, sides, lows, highs, texts = (batch.column(c) for c in ("region", "side", "lo", "hi", "text"))
            raw, offsets = string_buffers(texts)
            last, w = None, None
            for i, (r, s, lo, hi) in enumerate(zip(region.to_pylist(), sides.to_pylist(), lows.to_pylist(), highs.to_pylist(), strict=True)):
                data = raw[offsets[i]: offsets[i + 1]].tobytes()
                if data != last:
                    last, w = data, words_of(raw, offsets, i, i + 1)
                lo, hi = max(lo, 0), min(hi, len(w.start))
                if lo < hi:
                    for k, v in (("region", r), ("side", s), ("lo", lo), ("words", data[w.start[lo]: w.end[hi - 1]])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["region"], pa.int64()), pa.array(out["side"], pa.int32()),
                                              pa.array(out["lo"], pa.int32()), pa.array(out["words"], pa.binary())], names=list(out))

    return joined.mapInArrow(frugal(cut), "region long, side int, lo int, words binary")


def _along(lo: np.ndarray, hi: np.ndarray, order: list[int], step: int) -> np.ndarray:
    """A place in the other text for each shingle that occurs there (``order[lo:hi]``
    are its places), next to the diagonal of the shingle before (``step`` -1: after)."""
    place = np.full(len(lo), -1)
    last = None
    for i in np.flatnonzero(hi > lo)[::step].tolist():
        p, q = int(lo[i]), int(hi[i])
        if q - p > 1 and last is None:
            p = p if step == 1 else q - 1
        elif q - p > 1:
            want = at + i - last
            j = bisect_left(order, want, p, q)
            p = j if j < q and (j == p or order[j] - want <= want - order[j - 1]) else j - 1
        place[i] = at = order[p]
        last = i
    return place


#: Fewest matches of a passage in which no shingle occurs twice.
LEAST = -(-2 * PERCENT * WIDTH // (100 + PERCENT))


def _chains(p: np.ndarray, q: np.ndarray, plain: bool) -> list[np.ndarray]:
    """Matches ``(p, q)``, sorted by p, as chains that rise in both texts.  Two
    unbroken stretches are linked if some passage could hold the gap between.
    Chains of fewer than ``LEAST`` matches are given only if shingles may occur
    twice (not ``plain``) and they reach the least length."""
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
    first, end = np.append(0, cut), np.append(cut, len(p))
    gain = (100 - PERCENT) * (end - first)
    left = np.cumsum(gain[::-1])[::-1]
    best, before = gain.copy(), np.full(len(gain), -1)
    low = np.iinfo(np.int64).min
    start_p, start_q, last_p, last_q = p[first], q[first], p[end - 1], q[end - 1]
    reach = best + PERCENT * (last_p + last_q)  # less the place of the next stretch: the best of a chain that goes on there
    root, many = np.arange(len(gain)), end - first  # first stretch and matches of each chain
    for k in range(1, len(gain)):
        fits = np.where(last_q[:k] < start_q[k], reach[:k], low)
        j = int(fits.argmax())
        if fits[j] == low:
            continue
        value = int(fits[j]) - PERCENT * int(start_p[k] + start_q[k] - 2)
        if value + left[k] + 100 - PERCENT >= 0:
            before[k], root[k] = j, root[j]
            many[k] += many[j]
            best[k] += max(value, 0)
            reach[k] = best[k] + PERCENT * (last_p[k] + last_q[k])
    inner = set(before.tolist())
    out = []
    use = many >= LEAST
    if not plain:
        use |= np.minimum(last_p - start_p[root], last_q - start_q[root]) + 1 >= WIDTH
    for k in np.flatnonzero(use).tolist():
        if k not in inner:  # a last stretch
            path = []
            while k >= 0:
                path.append(np.arange(first[k], end[k]))
                k = int(before[k])
            out.append(np.concatenate(path[::-1]))
    return out


def _cover(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Few of the intervals (ends included, starts ascending) that cover what all cover."""
    top = np.maximum.accumulate(np.append(-1, end))
    new = end > top[:-1]
    start, end = start[new], end[new]
    out, i, done = [], 0, -1
    while i < len(start):
        i = max(i, int(np.searchsorted(start, done + 1, side="right")) - 1)
        out.append((int(start[i]), int(end[i])))
        done = int(end[i])
        i += 1
    return out


def _furthest(f: np.ndarray) -> np.ndarray:
    """For each place the last one from which Jaccard is ``PERCENT`` or more,
    where ``f`` is (100 + PERCENT) x matches - PERCENT x (both lengths) so far."""
    top = np.maximum.accumulate(f[::-1])[::-1]
    return np.searchsorted(-top, 100 - PERCENT - f, side="right") - 1


def _earlier(v: np.ndarray) -> np.ndarray:
    """Place of the same value before (-1: none)."""
    order = np.argsort(v, kind="stable")
    out = np.full(len(v), -1)
    same = v[order[1:]] == v[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _stretches(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, before) -> list[tuple[int, int, int, int]]:
    """Stretches of a chain of matches with enough shingles and Jaccard, ``(from,
    to, from, to)`` in shingles, ends included, that cover all there are.
    ``before``: places of the same shingles before in x and y, if any occurs twice."""
    m, each, least = len(p), np.arange(len(p)), LEAST
    if m < least and (before is None or min(p[-1] - p[0], q[-1] - q[0]) + 1 < WIDTH):
        return []
    out = []
    if before is None:  # no shingle occurs twice: the condition is a difference of f
        e = _furthest((100 + PERCENT) * each - PERCENT * (p + q))
        ok = (p[e] - p + 1 >= WIDTH) & (q[e] - q + 1 >= WIDTH)
        out = _cover(each[ok], e[ok])
    else:
        before_x, before_y = before
        before = None
        fresh_x, fresh_y = np.cumsum(before_x < 0), np.cumsum(before_y < 0)
        most = _furthest((100 + PERCENT) * each - PERCENT * (fresh_x[p] + fresh_y[q] - 2))  # no stretch goes further
        done = -1
        for s in np.flatnonzero((p[most] - p + 1 >= WIDTH) & (q[most] - q + 1 >= WIDTH)).tolist():
            e = int(most[s])
            if e <= done:
                continue
            if before is None:
                before = _earlier(x[p])
            n_x = np.cumsum(before_x[p[s]: p[e] + 1] < p[s])[p[s: e + 1] - p[s]]
            n_y = np.cumsum(before_y[q[s]: q[e] + 1] < q[s])[q[s: e + 1] - q[s]]
            both = np.cumsum(before[s: e + 1] < s)
            ok = ((100 + PERCENT) * both >= PERCENT * (n_x + n_y)) & (p[s: e + 1] - p[s] + 1 >= WIDTH) & (q[s: e + 1] - q[s] + 1 >= WIDTH)
            found = np.flatnonzero(ok)
            if len(found) and s + found[-1] > done:
                done = int(s + found[-1])
                out.append((s, done))
    spans = [(int(p[s]), int(p[e]), int(q[s]), int(q[e])) for s, e in out]
    # shorter chains reach the least length with shingles that differ at an end, if they are dense enough
    widest = (100 + PERCENT) * (WIDTH - 1) // PERCENT - WIDTH
    if m < least or not ((p[least - 1:] - p[: m - least + 1] < widest) & (q[least - 1:] - q[: m - least + 1] < widest)).any():
        return spans
    top = np.append(-1, [x1 for _, x1, _, _ in spans])  # ends ascend
    starts = np.array([x0 for x0, _, _, _ in spans], np.int64)
    reach = np.full(len(x), -1)  # the furthest end of these spans that begin up to each place: it rises
    for n in range(least, WIDTH):
        if n > m:
            break
        s, e = each[: m - n + 1], each[n - 1:]
        wide_x, wide_y = np.maximum(p[e] - p[s] + 1, WIDTH), np.maximum(q[e] - q[s] + 1, WIDTH)
        free = top[np.searchsorted(starts, p[s], side="right")] < p[e]
        for i in np.flatnonzero(free & ((100 + PERCENT) * n >= PERCENT * (wide_x + wide_y))).tolist():
            if reach[p[s[i]]] >= p[e[i]]:
                continue
            x0, y0 = min(int(p[s[i]]), len(x) - int(wide_x[i])), min(int(q[s[i]]), len(y) - int(wide_y[i]))
            spans.append((x0, x0 + int(wide_x[i]) - 1, y0, y0 + int(wide_y[i]) - 1))
            reach[x0: max(x0, int(np.searchsorted(reach, spans[-1][1])))] = spans[-1][1]
    return spans


def passages(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Verified stretches of two shingle sequences: ``(from, to, from, to,
    Jaccard)`` in words, ends excluded.  A run of matches that passes as a whole
    is one; beyond, all stretches of matches in order are searched (``_stretches``)."""
    if len(x) < WIDTH or len(y) < WIDTH:
        return []
    order = np.argsort(y, kind="stable")
    z = y[order]
    lo, hi = np.searchsorted(z, x), np.searchsorted(z, x, side="right")
    at = np.flatnonzero(hi > lo)
    once = not (z[1:] == z[:-1]).any()
    plain = once and len(np.unique(x)) == len(x)
    if not len(at) or plain and (100 + PERCENT) * len(at) < 2 * PERCENT * WIDTH:
        return []
    places = [order[np.minimum(lo, len(y) - 1)]] if once else [_along(lo, hi, order.tolist(), step) for step in (1, -1)]
    if len(places) > 1 and np.array_equal(*places):
        places.pop()
    before = None
    out: list[tuple[int, int, int, int, float]] = []
    seen: set[bytes] = set()

    def check(x0: int, x1: int, y0: int, y1: int) -> bool:
        if x1 - x0 + 1 < WIDTH or y1 - y0 + 1 < WIDTH:
            return False
        if plain:  # every shingle has one place
            among = place[x0: x1 + 1][hi[x0: x1 + 1] > lo[x0: x1 + 1]]
            both = int(np.count_nonzero((among >= y0) & (among <= y1)))
            union = x1 - x0 + 1 + y1 - y0 + 1 - both
        else:
            p, q = np.unique(x[x0: x1 + 1]), np.unique(y[y0: y1 + 1])
            both = len(np.intersect1d(p, q, assume_unique=True))
            union = len(p) + len(q) - both
        if 100 * both < PERCENT * union:
            return False
        out.append((x0, x1 + SHINGLE, y0, y1 + SHINGLE, both / union))
        return True

    for place in places:
        runs = np.split(at, np.flatnonzero(np.diff(at) > GAP) + 1)
        whole = [check(int(r[0]), int(r[-1]), int(place[r].min()), int(place[r].max())) for r in runs]
        if whole == [True]:
            return out[-1:]
        if not plain and before is None:
            before = _earlier(x), _earlier(y)
        for chain in _chains(at, place[at], plain):
            p, q = at[chain], place[at][chain]
            if not plain:  # both directions may lead to the same chain
                name = p.tobytes() + q.tobytes()
                if name in seen:
                    continue
                seen.add(name)
            for span in _stretches(x, y, p, q, before):
                check(*span)
    out = list(dict.fromkeys(out))
    return [r for r in out if not any(r is not o and o[0] <= r[0] and r[1] <= o[1] and o[2] <= r[2] and r[3] <= o[3] for o in out)]


RESULT = "doc_id long, start_word int, end_word int, first_doc_id long, first_start_word int, first_end_word int, jaccard double"


def verified(found: DataFrame, sliced: DataFrame) -> DataFrame:
    """The passages of every region."""
    left = sliced.filter("side = 0").select("region", F.col("lo").alias("x_lo"), F.col("words").alias("x"))
    right = sliced.filter("side = 1").select("region", F.col("lo").alias("y_lo"), F.col("words").alias("y"))
    both = found.select("region", "a", "b").join(left, "region").join(right, "region")

    def check(batches):
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                pairs = zip(shingle_lists(part.column("x"), SHINGLE), shingle_lists(part.column("y"), SHINGLE), strict=True)
                places = zip(*(part.column(c).to_pylist() for c in ("a", "b", "x_lo", "y_lo")), strict=True)
                for (a, b, x_lo, y_lo), (x, y) in zip(places, pairs, strict=True):
                    rows.extend((a, x_lo + x0, x_lo + x1, b, y_lo + y0, y_lo + y1, j) for x0, x1, y0, y1, j in passages(x, y))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=[f.split()[0] for f in RESULT.split(", ")])

    return both.mapInArrow(frugal(check), RESULT).distinct()


def spans(sh: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` shingles."""
    n, power, width, out, done = len(sh), sh, 1, None, 0
    while True:
        if size & width:
            have = power[done: max(n - width + 1, 0)]
            out = have if out is None else mix(out[: len(have)] * U64(0xD6E8FEB86659FD93) + have)
            done += width
        if done == size:
            return out
        power = mix(power[:-width] * U64(0x9FB21C651E98DF25) + power[width:])
        width *= 2


def _shingled(batch):
    """``(documents, shingles, their documents, first shingle of each document)`` of blocks of a batch."""
    raw, offsets = string_buffers(batch.column("text"))
    for lo, hi in blocks(offsets):
        w = words_of(raw, offsets, lo, hi, lower=True)
        sh, at = shingles(w, SHINGLE)
        doc = w.doc[at]
        if len(sh) >= WIDTH:
            yield np.arange(lo, hi), sh, doc, np.searchsorted(doc, np.arange(hi - lo))


PARTS = "part long, doc long, u int, v int"


def chosen_parts(docs: DataFrame) -> DataFrame:
    """The parts that windows choose: those that begin at ``u`` to ``v`` choose one."""

    def build(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at, sh, doc, first in _shingled(batch):
                part = spans(sh, PART)
                low = U64((1 << int(len(sh)).bit_length()) - 1)
                key = (mix(part) & ~low) | np.arange(len(part), dtype=U64)
                u = np.flatnonzero(doc[: len(sh) - WIDTH + 1] == doc[WIDTH - 1:])
                c = (sliding_minimum(key, WIDTH - PART + 1)[u] & low).astype(np.int64)
                new = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else c
                v, u, c = u[np.append(new[1:], len(c)) - 1] if len(c) else u, u[new], c[new]
                start = first[doc[u]]
                yield pa.RecordBatch.from_arrays([pa.array(part[c].view(np.int64)), pa.array(ids[at][doc[u]]), pa.array((u - start).astype(np.int32)),
                                                  pa.array((v - start).astype(np.int32))], names=["part", "doc", "u", "v"])

    return docs.mapInArrow(frugal(build), PARTS)


def whole_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, doc, at, open)`` of the windows of ``wanted`` (rows ``doc, u, v, open``), keyed by all their words."""
    ranges = wanted.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("u", "v", "open")).alias("ranges"))

    def build(batches):
        for batch in batches:
            ids, ranges = batch.column("id").to_numpy(), batch.column("ranges")
            for docs_of, sh, doc, first in _shingled(batch):
                whole = spans(sh, WIDTH)
                inside = doc[: len(whole)] == doc[WIDTH - 1:]
                use = np.zeros(len(whole), dtype=np.int8)
                for i, r in enumerate(ranges.slice(int(docs_of[0]), len(docs_of)).to_pylist()):
                    for x in r:  # open windows after the others
                        part = use[first[i] + x["u"]: first[i] + x["v"] + 1]
                        np.maximum(part, 1 + x["open"], out=part)
                at = np.flatnonzero(inside & (use > 0))
                yield pa.RecordBatch.from_arrays([pa.array(whole[at].view(np.int64)), pa.array(ids[docs_of][doc[at]]), pa.array((at - first[doc[at]]).astype(np.int32)),
                                                  pa.array(use[at] > 1)], names=["key", "doc", "at", "open"])

    return docs.join(ranges, "id").mapInArrow(frugal(build), "key long, doc long, at int, open boolean")


def equal_rest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The equal passages that ``found`` leaves, each tied to its earliest holder."""
    parts = written(chosen_parts(docs), "parts")
    held = parts.groupBy("part").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("part", "first")
    pair = F.array_sort(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))))
    grown = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
        F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e"))))
    joined = F.aggregate("p", F.slice("p", 1, 1), lambda done, x: F.when(x["s"] <= F.element_at(done, -1)["e"], grown(done, x)).otherwise(F.concat(done, F.array(x))))
    known = found.groupBy(F.col("doc_id").alias("doc")).agg(pair.alias("p")).select("doc", joined.alias("p"))
    inside = F.exists("p", lambda x: (x["s"] <= F.col("u")) & (F.col("v") + MIN_WORDS <= x["e"]))
    rows = parts.join(held, "part").join(known, "doc", "left")
    rows = written(rows.select("part", "doc", "u", "v", ((F.col("doc") > F.col("first")) & ~F.coalesce(inside, F.lit(False))).alias("open")), "parts")
    release(docs.sparkSession)
    wanted = rows.join(rows.filter("open").select("part").distinct(), "part", "left_semi")
    keyed = written(whole_windows(docs, wanted), "whole-windows")
    release(docs.sparkSession)
    heads = keyed.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("head"), F.max("doc").alias("last")).filter("head.doc < last")
    ties = keyed.filter("open").join(heads, "key").filter("doc > head.doc")
    ties = ties.select("doc", "at", F.col("head.doc").alias("first"), (F.col("at") - F.col("head.at")).alias("shift")).distinct()
    row = F.row_number().over(Window.partitionBy("doc", "first", "shift").orderBy("at"))
    runs = ties.withColumn("run", F.col("at") - row).groupBy("doc", "first", "shift", "run").agg(F.min("at").alias("lo"), (F.max("at") + MIN_WORDS).alias("hi"))
    return runs.select(F.col("doc").alias("doc_id"), F.col("lo").alias("start_word"), F.col("hi").alias("end_word"), F.col("first").alias("first_doc_id"),
                       (F.col("lo") - F.col("shift")).alias("first_start_word"), (F.col("hi") - F.col("shift")).alias("first_end_word"), F.lit(1.0).alias("jaccard"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified pairs of passages, the later document first (see the module)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    found = _near_passages(keyed)
    return found.unionByName(written(equal_rest(keyed, found), "passages")).distinct()


def _near_passages(keyed: DataFrame) -> DataFrame:
    """Steps 1 to 3."""
    ties = written(all_ties(window_rows(keyed)), "window-ties")
    release(keyed.sparkSession)
    found = written(regions(ties), "regions")
    release(keyed.sparkSession)
    first = found.filter("not held")
    sure = written(verified(first, written(slices(keyed, first), "slices")), "passages")
    release(keyed.sparkSession)
    # what was held back, but for cores that lie within a passage of the document
    spans = sure.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    rest = found.filter("held").join(spans, F.col("a") == F.col("doc_id"), "left")
    inside = F.exists("spans", lambda x: (x["start_word"] <= F.col("core_lo")) & (F.col("core_hi") <= x["end_word"]))
    rest = written(rest.filter(~F.coalesce(inside, F.lit(False))).select(*found.columns), "regions")
    if rest.isEmpty():
        return sure
    return sure.unionByName(written(verified(rest, written(slices(keyed, rest), "slices")), "passages")).distinct()


def op4_compact_windows(spark, sf_dir):
    """All repeated passages of the documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def without_repeats(spark, docs, sf_dir):
    """Pipeline stage: repeated passages are cut from every document but the
    first that holds them; documents without words left go.  ``n_chars``
    follows the text.  Rows without an id or text stay."""
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    spans = written(spans.select(F.col("doc_id").alias("_id"), "_spans"), "spans")
    may, stay = split_by(docs, F.col("doc_id").cast("long"), spans, "_id")  # rows without a passage to cut stay where they are
    rows = may.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(spans, "_id", "left").select("row", "text", "_spans")

    def cut(batches):
        for batch in batches:
            texts, raw_offsets = batch.column("text"), string_buffers(batch.column("text"))
            raw, offsets = raw_offsets
            out = texts.to_pylist()
            for i, spans_of in enumerate(batch.column("_spans").to_pylist()):
                if not spans_of or out[i] is None:
                    continue
                data, w = raw[offsets[i]: offsets[i + 1]].tobytes(), words_of(raw, offsets, i, i + 1)
                kept, at = [], 0
                for lo, hi in sorted((s["start_word"], s["end_word"]) for s in spans_of):
                    if hi > at:
                        kept.append((at, max(at, lo)))
                        at = max(at, hi)
                kept.append((at, len(w.start)))
                parts = [data[w.start[p]: w.end[q - 1]] for p, q in kept if p < q]
                out[i] = b"\n".join(parts).decode() if parts else None
            cuts = pa.array([bool(s) for s in batch.column("_spans").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), cuts], names=["row", "_text", "_cut"])

    done = joined.mapInArrow(frugal(cut), plus(rows.select("row").schema, _text="string", _cut="boolean"))
    done = done.filter(~F.col("_cut") | F.col("_text").isNotNull())
    fresh = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    cols = []
    for f in docs.schema.fields:
        old = F.col("row").getField(f.name)
        cols.append(F.when(F.col("_cut"), fresh[f.name].cast(f.dataType)).otherwise(old).alias(f.name) if f.name in fresh else old.alias(f.name))
    return stay.unionByName(done.select(*cols))
