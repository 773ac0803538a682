"""Exact Jaccard join of documents through a token-group matrix.

Documents are sets of 3-word shingles; two link when 100 * |intersection| >=
``PERCENT`` * |union|.  The result is one row per document with its component,
never all pairs.

1. Equal sets become one class.  The shingles of a class are dealt by hash into
   ``d + SPARE`` parts, d being the most shingles in which two linked sets of
   this size can differ: two linked sets agree in ``SPARE`` whole parts or more.
   The hashes of the parts are the keys of the class.  Sizes meet in bands, so a
   class has the keys of its own band and of the next one.
2. Similar classes are put into groups: holders of a key are tied to a
   representative of like size, every class's strongest tie is verified on
   the whole texts, and connected classes form a group.
3. The token-group matrix stores each group's union of shingles as a row of
   ``BITS`` bits.  A class that shares a key with a group other than its own
   queries it: if so many of its bits are absent from the union that no member
   can link, the group stays closed (a bit stands for one shingle or more, so
   the count of absent bits never exceeds that of absent shingles).
4. Qualifying groups are opened: the class is held against the rows of the
   members that share a key.  The closest pair of each group is compared on
   whole sets first, and groups that link become one, until none do; then every
   pair that is left between groups is compared.

Every linked pair shares a key, so it is either inside a group (2) or opened
(4): no link is lost and no pair within a group has to be listed.  Texts that
only share a passage or common words share no key, as a key stands for about
nine shingles from all over a text.  A group of near copies costs one tie per
member and key; members are tied inside each task first, so a key that a third
of all rows hold reaches the shuffle a few times per task.

Defined results: NULL or wordless texts have no shingles and link with nothing
(component = own id); texts under three words are one shingle; NULL ids get a
NULL component; repeated rows link; rows that share an id are one document for
the component; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.graph import components
from lexiframe.llm.kernels import U64, Words, blocks, mix, shingles, string_buffers, words_of
from lexiframe.llm.presence import split_by
from lexiframe.llm.storage import release, table, written
from lexiframe.llm.worker_memory import frugal, gathered, give_back

SHINGLE, PERCENT = 3, 90
#: Parts in which two linked sets agree at least.  A set with this many empty
#: parts or more has keys for its empty parts, too.
SPARE = 2
#: Bits of a row of the token-group matrix; bits compared at once.
BITS, BLOCK = 2048, 1 << 22
#: Key rows that one task ties before they are shuffled.
TIE_ROWS = 2_000_000
#: Rows handed to Spark at once: a batch is held by both sides.
SLICE = 1 << 16


def doc_shingles(w: Words, i: int, sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All shingle hashes of document ``i`` (``first``: where its shingles start)."""
    n = int(w.first[i + 1] - w.first[i])
    if 0 < n < SHINGLE:  # the whole sequence as one
        h = w.hash[w.first[i]: w.first[i + 1]].sum(dtype=U64) if n == 1 else mix(w.hash[w.first[i]: w.first[i] + 1] * U64(31) + w.hash[w.first[i] + 1])[0]
        return mix(np.array([h], dtype=U64) + U64(n))
    return sh[first[i]: first[i + 1]]


def _block_sets(column: pa.Array):
    """Yield ``(words, shingle hashes, first word of each, first shingle of each document, lo, hi)`` per block."""
    raw, offsets = string_buffers(column)
    for lo, hi in blocks(offsets):
        w = words_of(raw, offsets, lo, hi, lower=True)
        sh, at = shingles(w, SHINGLE)
        first = np.searchsorted(w.doc[at], np.arange(hi - lo + 1)) if len(at) else np.zeros(hi - lo + 1, np.int64)
        yield w, sh, at, first, lo, hi


def band_of(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and first size of the bands up to the largest size: two sizes
    that can link are in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= (int(size.max()) if len(size) else 1) * 2:
        starts.append(starts[-1] * 100 // PERCENT + 1)
    starts = np.array(starts, dtype=np.int64)
    return np.searchsorted(starts, size, side="right") - 1, starts


def part_keys(token: np.ndarray, doc: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Keys of every set.  ``token``: distinct shingles, set after set; ``doc``:
    their sets; ``size``: the sets' sizes."""
    band, starts = band_of(size)
    out: list[list[np.ndarray]] = [[] for _ in size]
    for step in (0, 1):
        top = starts[band + step + 1] - 1
        parts = (100 - PERCENT) * 2 * top // (100 + PERCENT) + SPARE
        base = np.concatenate([[0], np.cumsum(parts)])
        slot = base[doc] + ((token >> U64(11)) % parts[doc].astype(U64)).astype(np.int64)
        value = mix(token + U64(0x2545F4914F6CDD1D))
        low = np.bincount(slot, weights=(value & U64(0xFFFFFFFF)).astype(np.float64), minlength=base[-1]).astype(U64)
        high = np.bincount(slot, weights=(value >> U64(32)).astype(np.float64), minlength=base[-1]).astype(U64)
        count = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(size)), parts)
        place = (np.arange(base[-1]) - base[owner]).astype(U64)
        key = mix(mix(low + (high << U64(32)) + count.astype(U64)) + place * U64(0x9E3779B97F4A7C15) + (band[owner] + step).astype(U64))
        empty = np.add.reduceat(count == 0, base[:-1]) if len(size) else np.zeros(0, np.int64)
        keep = (count > 0) | (empty >= SPARE)[owner]
        for i in range(len(size)):
            mine = slice(base[i], base[i + 1])
            out[i].append(key[mine][keep[mine]])
    return [np.concatenate(k).view(np.int64) for k in out]


def _is_in(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each element stands in the sorted ``values``."""
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    i = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[i] == x


SETS = "id long, n long, s1 long, s2 long, keys array<long>, marks binary"


def set_rows(docs: DataFrame) -> DataFrame:
    """Size, 128-bit signature, keys and matrix shingles of every document's
    set; of equal sets within a block only the first carries the last two."""

    def sets(batches):
        for batch in batches:
            ids = batch.column("id")
            for w, sh, _, first, lo, hi in _block_sets(batch.column("text")):
                n, s1, s2, fresh, seen = [], [], [], {}, set()
                for i in range(hi - lo):
                    h = np.unique(doc_shingles(w, i, sh, first))
                    size = len(h)
                    a = int(mix(h + U64(1)).sum(dtype=U64)) if size else 0
                    b = int(np.bitwise_xor.reduce(mix(h + U64(77)))) if size else 0
                    n.append(size)
                    s1.append(a)
                    s2.append(b)
                    if size and (size, a, b) not in seen:
                        seen.add((size, a, b))
                        fresh[i] = h
                keys = [None] * (hi - lo)
                marks = [None] * (hi - lo)
                if fresh:
                    sizes = np.array([len(h) for h in fresh.values()])
                    found = part_keys(np.concatenate(list(fresh.values())), np.repeat(np.arange(len(sizes)), sizes), sizes)
                    for (i, h), k in zip(fresh.items(), found, strict=True):
                        row = np.zeros(BITS, dtype=bool)
                        row[(h >> U64(7)) % U64(BITS)] = True
                        keys[i], marks[i] = k, np.packbits(row).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(np.array(s1, dtype=U64).view(np.int64)),
                     pa.array(np.array(s2, dtype=U64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["id", "n", "s1", "s2", "keys", "marks"])

    return docs.mapInArrow(frugal(sets), SETS)


TIES = "token long, node long, size long, to long"


def _tie_block(token: np.ndarray, node: np.ndarray, size: np.ndarray):
    """Ties of one block of (key, class) rows.

    Classes of a key are taken by size; each is tied to the smallest class of
    its run, a run ending where sizes are too far apart to link (there the
    neighbour is tied, too).  Returns the smallest and the largest row of every
    run, which any class of another task that can link with the run can link
    with too (by size), and the ties."""
    order = np.lexsort((node, size, token))
    token, node, size = token[order], node[order], size[order]
    n = len(token)
    new = np.ones(n, dtype=bool)
    new[1:] = token[1:] != token[:-1]
    begins = np.flatnonzero(new)
    heads, a, b = [], [], []
    ends = np.append(begins[1:], n)
    multi = ends - begins > 1
    heads.append(begins[~multi])
    for s, e in zip(begins[multi].tolist(), ends[multi].tolist(), strict=True):
        i = s
        while i < e:
            run = i + int(np.searchsorted(size[i:e] * PERCENT, 100 * size[i], side="right"))
            heads.append(np.unique([i, run - 1]))
            a.append(np.arange(i + 1, run))
            b.append(np.full(run - i - 1, i))
            if run < e and size[run - 1] * 100 >= PERCENT * size[run]:
                a.append(np.array([run]))
                b.append(np.array([run - 1]))
            i = run
    head = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    x = np.concatenate(a) if a else np.zeros(0, np.int64)
    y = np.concatenate(b) if b else np.zeros(0, np.int64)
    return (token[head], node[head], size[head]), (node[x], size[x], node[y])


def tied_tokens(classes: DataFrame) -> DataFrame:
    """Rows ``(token, node, size, NULL)`` to be grouped by token, and rows
    ``(NULL, node, size, to)``: ties found inside this task."""

    def tie(batches):
        held, rows = [], 0

        def flush():
            heads, pairs = _tie_block(*gathered(held))
            pairs = _distinct_pairs(*pairs)
            give_back()
            yield from _sliced(_tie_rows(*heads, None))
            yield from _sliced(_tie_rows(None, *pairs))

        for batch in batches:
            lists = batch.column("keys")
            lengths = np.diff(lists.offsets.to_numpy())
            held.append((lists.flatten().to_numpy(), np.repeat(batch.column("node").to_numpy(), lengths),
                         np.repeat(batch.column("n").to_numpy(), lengths)))
            rows += int(lengths.sum())
            if rows >= TIE_ROWS:
                yield from flush()
                rows = 0
        if held:
            yield from flush()

    return classes.select("node", "n", "keys").mapInArrow(frugal(tie), TIES)


def _distinct_pairs(x: np.ndarray, size: np.ndarray, y: np.ndarray):
    if not len(x):
        return x, size, y
    order = np.lexsort((y, x))
    x, size, y = x[order], size[order], y[order]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[keep], size[keep], y[keep]


def _tie_rows(token, node, size, to) -> pa.RecordBatch:
    none = pa.nulls(len(node), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none if token is None else pa.array(token), pa.array(node), pa.array(size), none if to is None else pa.array(to)],
        names=["token", "node", "size", "to"])


def _sliced(rows: pa.RecordBatch):
    for lo in range(0, rows.num_rows, SLICE):
        yield rows.slice(lo, SLICE)


def grouped_ties(tied: DataFrame) -> DataFrame:
    """Ties over all tasks: rows of a token meet once per task, sorted by size."""
    heads = tied.filter("token is not null").select("token", "node", "size")
    dealt = heads.repartition("token").sortWithinPartitions("token", "size", "node")

    def tie(batches):
        rest = None
        for batch in batches:
            token, node, size = (batch.column(c).to_numpy() for c in ("token", "node", "size"))
            if rest is not None:
                token, node, size = (np.concatenate(p) for p in zip(rest, (token, node, size), strict=True))
            cut = int(np.searchsorted(token, token[-1])) if len(token) and np.all(token[1:] >= token[:-1]) else 0
            rest = (token[cut:], node[cut:], size[cut:])
            if cut:
                yield from _sliced(_tie_rows(None, *_distinct_pairs(*_tie_block(token[:cut], node[:cut], size[:cut])[1])))
        if rest is not None and len(rest[0]):
            yield from _sliced(_tie_rows(None, *_distinct_pairs(*_tie_block(*rest)[1])))

    found = dealt.mapInArrow(frugal(tie), TIES)
    both = found.select("node", "to").unionByName(tied.filter("token is null").select("node", "to"))
    return both.groupBy(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).agg(F.count("*").alias("ties"))


def strongest(ties: DataFrame) -> DataFrame:
    """Every class's tie with most shared keys, seen from both ends."""
    ends = ties.select("node", "to", "ties").unionByName(ties.select(F.col("to").alias("node"), F.col("node").alias("to"), "ties"))
    best = ends.groupBy("node").agg(F.max(F.struct("ties", (-F.col("to")).alias("to"))).alias("t")).select("node", (-F.col("t.to")).alias("to"))
    return best.select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(node, to)`` that link, by the sets of their whole texts.
    Only texts that may be in a pair move; those of both sides meet by pair, so a
    class of many pairs is spread."""
    docs, _ = split_by(docs, F.col("id"), pairs.select(F.explode(F.array("node", "to")).alias("id")), "id")
    named = pairs.select("node", "to", F.xxhash64("node", "to").alias("pair"))
    ends = named.select("pair", F.explode(F.array(F.struct(F.col("node").alias("id"), F.lit(0).alias("side")),
                                                  F.struct(F.col("to").alias("id"), F.lit(1).alias("side")))).alias("e")).select("pair", "e.*")
    texts = written(docs.join(ends, "id").select("id", "pair", "side", "text"), "pair-texts")
    a = texts.filter("side = 0").select("pair", F.col("id").alias("node"), F.col("text").alias("a"))
    b = texts.filter("side = 1").select("pair", F.col("id").alias("to"), F.col("text").alias("b"))

    def sets(column):
        out = []
        for w, sh, _, first, lo, hi in _block_sets(column):
            out.extend(np.unique(doc_shingles(w, i, sh, first)) for i in range(hi - lo))
        return out

    def compare(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                good = []
                for u, v in zip(sets(part.column("a")), sets(part.column("b")), strict=True):
                    shared = int(_is_in(u, v).sum()) if len(u) <= len(v) else int(_is_in(v, u).sum())
                    good.append(100 * shared >= PERCENT * (len(u) + len(v) - shared) and shared > 0)
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in ("node", "to")], names=["node", "to"])

    return a.join(b, "pair").select("node", "to", "a", "b").mapInArrow(frugal(compare), "node long, to long").distinct()


def _open_groups(node: np.ndarray, size: np.ndarray, label: np.ndarray, row: np.ndarray, closest: bool) -> np.ndarray:
    """Pairs of the holders of one key that the matrix does not rule out, as
    rows (lower group, higher group, absent bits, node, node); ``closest``: the
    closest pair of each group alone."""
    order = np.lexsort((node, label))
    node, size, label, row = node[order], size[order], label[order], row[order]
    start = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    end = np.append(start[1:], len(label))
    union = np.bitwise_or.reduceat(row, start, axis=0)
    least, most = np.minimum.reduceat(size, start), np.maximum.reduceat(size, start)
    own = np.repeat(np.arange(len(start)), end - start)
    found = [np.zeros((0, 5), np.int64)]
    step = max(1, BLOCK // (len(start) * BITS // 8))
    for i in range(0, len(node), step):
        x = size[i: i + step, None]
        absent = np.bitwise_count(row[i: i + step, None, :] & ~union[None]).sum(axis=2, dtype=np.int64)
        y = np.maximum(least[None], -(-PERCENT * x // 100))  # the smallest member that can link
        opens = (absent <= (100 * x - PERCENT * y) // (100 + PERCENT)) & (100 * most[None] >= PERCENT * x) & (PERCENT * least[None] <= 100 * x)
        opens &= own[i: i + step, None] != np.arange(len(start))[None]
        who, group = np.nonzero(opens)
        count = end[group] - start[group]
        a = np.repeat(who + i, count)
        b = np.repeat(start[group] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(group) else np.zeros(0, np.int64)
        for j in range(0, len(a), max(1, BLOCK * 8 // BITS)):
            p, q = a[j: j + BLOCK * 8 // BITS], b[j: j + BLOCK * 8 // BITS]
            miss_p = np.bitwise_count(row[p] & ~row[q]).sum(axis=1, dtype=np.int64)
            miss_q = np.bitwise_count(row[q] & ~row[p]).sum(axis=1, dtype=np.int64)
            ok = (miss_p <= (100 * size[p] - PERCENT * size[q]) // (100 + PERCENT)) & (miss_q <= (100 * size[q] - PERCENT * size[p]) // (100 + PERCENT))
            p, q = p[ok], q[ok]
            low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
            found.append(_closest(np.stack([low, high, (miss_p + miss_q)[ok], np.maximum(node[p], node[q]), np.minimum(node[p], node[q])], axis=1), closest))
    return _closest(np.concatenate(found), closest)


def _closest(pairs: np.ndarray, one: bool) -> np.ndarray:
    """Distinct rows; ``one``: the closest row of each group."""
    if not len(pairs):
        return pairs
    if one:
        label = np.concatenate([pairs[:, 0], pairs[:, 1]])
        rows = np.concatenate([pairs, pairs])
        order = np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], label))
        label, rows = label[order], rows[order]
        pairs = rows[np.append(True, label[1:] != label[:-1])]
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]


def opened_pairs(classes: DataFrame, groups: DataFrame, tested: DataFrame, closest: bool) -> DataFrame:
    """Pairs of classes of different groups that share a key, for the (class,
    group) queries that the matrix does not rule out: the closest pair of each
    group (``closest``) or all.  Only keys whose holders lie in two groups or
    more are looked at."""
    near = classes.join(groups, "node")  # classes with a tie: (node, n, keys, marks, label)
    tokens = written(near.select("node", F.col("n").alias("size"), "label", F.explode("keys").alias("token")), "group-keys")
    # min and max are pre-aggregated in each task
    split = written(tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token"), "split-keys")
    some, _ = split_by(tokens, F.col("token"), split, "token")
    cross = written(some.join(split, "token"), "cross-keys").join(classes.select("node", "marks"), "node")
    dealt = cross.select("token", "node", "size", "label", "marks").repartition("token").sortWithinPartitions("token", "size", "node")

    def compare(batches):
        rest = None

        def pairs(cols):
            token = cols[0]
            cut = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
            found = [_open_groups(*[c[lo:hi] for c in cols[1:]], closest) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if hi - lo > 1]
            if found:
                rows = _closest(np.concatenate(found), closest)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=["low", "high", "miss", "node", "to"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("token", "node", "size", "label")]
            marks = b"".join(batch.column("marks").to_pylist())
            cols.append(np.frombuffer(marks, dtype=U64).reshape(batch.num_rows, BITS // 64))
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if batch.num_rows else 0
            if cut:
                yield from pairs([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            yield from pairs(rest)

    found = dealt.mapInArrow(frugal(compare), "low long, high long, miss long, node long, to long")
    if closest:
        ends = found.select(F.explode(F.array("low", "high")).alias("label"), "miss", "node", "to")
        found = ends.groupBy("label").agg(F.min(F.struct("miss", "node", "to")).alias("b")).select("b.node", "b.to")
    return found.select("node", "to").distinct().join(tested, ["node", "to"], "left_anti")


def jaccard_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(set_rows(keyed), "sets")
    key = ["n", "s1", "s2"]
    spark = docs.sparkSession
    usable = rows.filter("n > 0 and id is not null")
    names = written(usable.groupBy(*key).agg(F.min("id").alias("node")), "class-names")
    first = usable.filter("keys is not null").groupBy(*key).agg(F.first(F.struct("keys", "marks")).alias("f"))  # equal within a class
    classes = written(names.join(first, key).select("node", "n", "f.keys", "f.marks"), "classes")
    ties = written(grouped_ties(tied_tokens(classes)), "ties")
    release(spark)
    tested = written(strongest(ties), "pairs")
    links = written(verified(tested, keyed), "links")
    release(spark)
    groups = components(links, "node", "to")
    # classes with a tie but no link are groups of one
    nodes = ties.select("node").unionByName(ties.select(F.col("to").alias("node"))).distinct()
    nodes = written(nodes, "tied-nodes")
    some, _ = split_by(classes, F.col("node"), nodes, "node")
    tied = written(some.join(nodes, "node", "left_semi"), "tied-classes")  # all rounds look at these alone
    labels, closest = groups, True
    while True:
        groups_of = written(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "groups")
        opened = written(opened_pairs(tied, groups_of, tested, closest), "pairs")
        release(spark)
        more = written(verified(opened, keyed), "links")
        release(spark)
        merged = not more.isEmpty()
        if merged:  # groups that link become one
            links = links.unionByName(more)
            labels = components(links, "node", "to")
        tested = tested.unionByName(opened)
        if not closest:
            break
        closest = merged
    return (rows.select("id", *key).join(names, key, "left").join(labels, "node", "left")
            .select("id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "node")).alias("component_id")))


def op6_jaccard_groups(spark, sf_dir):
    """Set size and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def one_per_group(spark, docs, sf_dir):
    """Pipeline stage: of each component the row with the smallest id stays (of rows
    that share it, the one with the smallest hash of its text).

    Rows are told apart by id and text, so rows that share an id but not their text
    are judged apart; equal rows are one document, and one stays; rows without an id
    stay."""
    from pyspark.sql import Window

    text = F.col("text").cast("string")
    key = F.xxhash64("doc_id", text, text.isNull())
    named = docs.filter("doc_id is not null")
    found = jaccard_components(named.select(key.alias("key"), "text"), "key", "text").select(F.col("id").alias("key"), "component_id").distinct()
    ids = written(named.select("doc_id", key.alias("key")), "row-keys")
    placed = written(ids.distinct().join(found, "key"), "row-components")
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = written(placed.join(first, "component_id").filter(F.struct("doc_id", "key") != F.col("first")).select(F.col("key").alias("_gone")).distinct(), "gone")
    again = ids.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_again"))
    again = written(again.join(gone, F.col("_again") == F.col("_gone"), "left_anti"), "equal-rows")
    # only rows that may go or be equal move
    may, stay = split_by(docs, key, gone.unionByName(again.select(F.col("_again").alias("_gone"))), "_gone")
    left = may.join(gone, (key == F.col("_gone")) & F.col("doc_id").isNotNull(), "left_anti")
    same = (key == F.col("_again")) & F.col("doc_id").isNotNull()
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_all"))
    equal = left.join(again, same, "left_semi").select("*", key.alias("_key"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    one = equal.withColumn("_nth", nth).filter("_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return stay.unionByName(left.join(again, same, "left_anti")).unionByName(one)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS t FROM documents),
l AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: concat_ws(' ', t[i], t[i + 1], t[i + 2])))
                          WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(coalesce(s, [])) AS n FROM l),
s AS (SELECT doc_id, unnest(s) AS sh FROM l),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.b AS component_id
FROM n JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = n.doc_id
"""
