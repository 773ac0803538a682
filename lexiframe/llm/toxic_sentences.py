"""Toxicity by multiple-instance learning.

Only whole documents have labels; a document is a bag of sentences and is toxic if
any sentence is.  A sentence's chance is a logistic score of its distinct words and
word beginnings (hashed), and the document's is their noisy-or, ``1 - prod(1 - p)``.
The gradient of the document's likelihood shares the blame of a toxic label among
its sentences by their own chances, so the sentences that carry the toxic words are
learned from document labels alone (weights of words are never negative: nothing in a
sentence excuses another part of it), and are located afterwards: every sentence with
a chance of at least ``OFFENDING`` is reported with its place.

The model is trained on at most about ``TRAIN_DOCS`` labelled documents, chosen by
a hash of the id: each of ``TRAIN_PARTS`` parts makes a pass of adaptive gradient
steps, and after each pass every weight is averaged over the parts that moved it.
Scores use whole texts and nothing but texts.

A sentence ends at ``. ! ?`` or a line break; a word is a run of letters (any
character beyond ASCII counts as one), compared without the case of A-Z.

Defined results: a NULL, empty or wordless text has no sentence and scores 0;
very long texts are read whole, sentence by sentence; ties cannot occur (a score is
a function of the text, so repeated rows score equally); NULL ids are scored like
others, are not held out and train nothing; of several labels of an id any toxic one
counts; with no labels to learn from
the first log odds stay and no word counts; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.kernels import U64, blocks, mix, string_buffers, words_of
from lexiframe.llm.storage import table, written

#: Documents of the training sample, its parts and passes, and the hashed weights.
TRAIN_DOCS, TRAIN_PARTS, PASSES, WEIGHTS = 16_384, 8, 10, 1 << 18
#: Bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Step size, squared gradient that a weight starts from (rare features then move little),
#: share of a weight lost per pass, and the first log odds of any sentence.
RATE, DAMPING, DECAY, START = 1.0, 1.0, 0.02, -7.0
#: One label in so many is held out; a document is toxic, and a sentence offends, from these chances on.
FOLDS, TOXIC, OFFENDING = 5, 0.5, 0.5

# byte -> byte of a word, or a blank: letters stay (A-Z in lower case), so does all beyond ASCII
_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def block_sentences(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
    """Words of a block of documents, the sentence of each word (numbered over the
    block, sentences without words left out), the document of each sentence, and
    which words are the first of their kind in their sentence."""
    data = raw[int(offsets[lo]): int(offsets[hi])]
    w = words_of(_LETTER[data], offsets[lo: hi + 1] - offsets[lo], 0, hi - lo)
    if not len(w.hash):
        none = np.zeros(0, np.int64)
        return w, none, none, np.zeros(0, bool)
    ends = np.cumsum(_ENDS[data])[w.start]
    new = np.r_[True, (ends[1:] != ends[:-1]) | (w.doc[1:] != w.doc[:-1])]
    sentence = np.cumsum(new) - 1
    _, at = np.unique(mix(w.hash ^ mix(sentence.astype(U64))), return_index=True)
    fresh = np.zeros(len(w.hash), dtype=bool)
    fresh[at] = True
    return w, sentence, w.doc[new], fresh


def slots_of(w, pick: np.ndarray) -> np.ndarray:
    """Hashed features of the picked words, one row per word: the word and its
    proper beginnings; a feature that a word lacks has the slot ``WEIGHTS``."""
    start, end = w.start[pick], w.end[pick]
    out = np.full((len(start), 1 + len(BEGINNINGS)), WEIGHTS, dtype=np.int64)
    out[:, 0] = (mix(w.hash[pick] + U64(1)) % U64(WEIGHTS)).astype(np.int64)
    packed, size = np.zeros(len(start), dtype=U64), end - start
    for i in range(max(BEGINNINGS)):
        has = size > i
        packed[has] |= w.data[start[has] + i].astype(U64) << U64(8 * i)
        if i + 1 in BEGINNINGS:
            proper = size > i + 1
            out[proper, 1 + BEGINNINGS.index(i + 1)] = (mix(packed[proper] + U64(2 * i + 3)) % U64(WEIGHTS)).astype(np.int64)
    return out


def _training_rows(batches):
    for batch in batches:
        raw, offsets = string_buffers(batch.column("text"))
        for lo, hi in blocks(offsets):
            w, sentence, _, fresh = block_sentences(raw, offsets, lo, hi)
            at = np.flatnonzero(fresh)
            slots = slots_of(w, at)
            cut = np.searchsorted(w.doc[at], np.arange(hi - lo + 1)) if len(at) else np.zeros(hi - lo + 1, np.int64)
            slot, place = [], []
            for i in range(hi - lo):
                mine = slots[cut[i]: cut[i + 1]]
                own = sentence[at[cut[i]: cut[i + 1]]]
                used = mine < WEIGHTS
                slot.append(mine[used].astype(np.int32))
                place.append(np.repeat(own - (own[0] if len(own) else 0), used.sum(axis=1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo),
                 pa.array(slot, pa.list_(pa.int32())), pa.array(place, pa.list_(pa.int32()))], names=["key", "toxic", "slots", "places"])


def _soft(z):
    return np.logaddexp(0.0, z)


def descend(weights: np.ndarray, squares: np.ndarray, toxic: int, slots: np.ndarray, places: np.ndarray) -> None:
    """One step for one document, in place; the bias is the last weight."""
    if not len(slots):
        return
    z = np.bincount(places, weights=weights[slots]) + weights[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    if toxic:
        whole = -np.expm1(-_soft(z).sum())
        share = -(1 - whole) / max(whole, 1e-300) * p
    else:
        share = p
    g = share[places]
    np.add.at(squares, slots, g * g)
    np.subtract.at(weights, slots, RATE * g / np.sqrt(squares[slots] + DAMPING))
    weights[slots] = np.maximum(weights[slots], 0.0)
    total = share.sum()
    squares[-1] += total * total
    weights[-1] -= 0.1 * RATE * total / np.sqrt(squares[-1] + DAMPING)


def first_weights() -> np.ndarray:
    return np.r_[np.zeros(WEIGHTS), START]


def mixed(weights: np.ndarray, squares: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]):
    """Weights and squared gradients after a pass: a weight is averaged over the
    parts that moved it, by how much gradient they saw."""
    seen = [s - squares for _, s in parts]
    whole = sum(seen)
    moved = whole > 0
    new = weights.copy()
    new[moved] = sum(w * s for (w, _), s in zip(parts, seen, strict=True))[moved] / whole[moved]
    new[:-1] *= 1 - DECAY
    return new, squares + whole / len(parts)


def train(sample: DataFrame) -> np.ndarray:
    """Weights (and the bias, last) from rows ``(key, toxic, text)``."""
    rows = written(sample.mapInArrow(_training_rows, "key long, toxic int, slots array<int>, places array<int>"), "train")
    rows = written(rows.repartition(TRAIN_PARTS, "key").sortWithinPartitions("key"), "train")
    weights, squares = first_weights(), np.zeros(WEIGHTS + 1)
    for _ in range(PASSES):
        state = (weights.astype(np.float32).tobytes(), squares.astype(np.float32).tobytes())

        def run(batches, state=state):
            w, s = (np.frombuffer(b, np.float32).astype(np.float64) for b in state)
            n = 0
            for batch in batches:
                toxic = batch.column("toxic").to_numpy()
                slots, places = batch.column("slots"), batch.column("places")
                for i in range(batch.num_rows):
                    descend(w, s, int(toxic[i]), slots[i].values.to_numpy(), places[i].values.to_numpy())
                    n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([s.astype(np.float32).tobytes()], pa.binary())], names=["w", "s"])

        # at most TRAIN_PARTS rows of 2 * WEIGHTS numbers, however many files the bounded sample has
        parts = rows.coalesce(TRAIN_PARTS).mapInArrow(run, "w binary, s binary").collect()
        parts = sorted((bytes(r["w"]), bytes(r["s"])) for r in parts)
        if not parts:
            return first_weights()
        start = np.frombuffer(state[1], np.float32).astype(np.float64)
        weights, squares = mixed(weights, start, [tuple(np.frombuffer(b, np.float32).astype(np.float64) for b in p) for p in parts])
    return weights


def score_batch(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, weights: np.ndarray):
    """Per document of a block its score, and per offending sentence its document,
    start and length in code points, and chance."""
    w, sentence, doc, fresh = block_sentences(raw, offsets, lo, hi)
    if not len(sentence):
        none = np.zeros(0, np.int64)
        return np.zeros(hi - lo), np.bincount(doc, minlength=hi - lo), (none, none, none, np.zeros(0))
    padded = np.r_[weights[:-1], 0.0]
    at = np.flatnonzero(fresh)
    z = np.bincount(sentence[at], weights=padded[slots_of(w, at)].sum(axis=1), minlength=len(doc)) + weights[-1]
    score = -np.expm1(-np.bincount(doc, weights=_soft(z), minlength=hi - lo))
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    bad = np.flatnonzero(p >= OFFENDING)
    if not len(bad):
        none = np.zeros(0, np.int64)
        return score, np.bincount(doc, minlength=hi - lo), (none, none, none, np.zeros(0))
    first = np.searchsorted(sentence, bad)
    last = np.searchsorted(sentence, bad, side="right") - 1
    data = raw[int(offsets[lo]): int(offsets[hi])]
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of each byte of the block
    begin = (offsets[lo: hi + 1] - offsets[lo])[doc[bad]]
    start = point[w.start[first]] - point[np.minimum(begin, len(data) - 1)]
    length = point[w.end[last] - 1] - point[w.start[first]] + 1
    return score, np.bincount(doc, minlength=hi - lo), (doc[bad], start, length, p[bad])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("chance", pa.float64())]))


def score(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(id, score, n_sentences, offending)`` of rows ``(id, text)``; ``offending``
    holds start and length in code points and the chance of each offending sentence."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # WEIGHTS + 1 numbers

    def run(batches):
        weights = shared.value
        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for lo, hi in blocks(offsets):
                scores, sentences, (doc, start, length, chance) = score_batch(raw, offsets, lo, hi, weights)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(chance, pa.float64())], fields=list(_SPANS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(scores), pa.array(sentences, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], names=["id", "score", "n_sentences", "offending"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, n_sentences long, offending array<struct<start:long,length:long,chance:double>>")


def in_fold(id_):
    """Whether a label is held out: unsigned crc32 of the id as text, modulo ``FOLDS``, is 0."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, held_out, score, predicted, n_sentences, offending)`` of documents
    ``(id, text)``, learned from ``labels`` ``(id, toxic)`` that are not held out."""
    known = labels.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold(F.col("id")))
    known = written(known.groupBy("id").agg(F.max("toxic").alias("toxic")), "known")
    # a written table of ids: its count is read from the files' footers
    share = min(1.0, TRAIN_DOCS / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # about TRAIN_DOCS small rows, whatever the input
    sample = docs.filter("text is not null").join(F.broadcast(picked), "id").select(F.xxhash64("id", "text").alias("key"), "toxic", "text")
    weights = train(sample)
    scored = score(docs.select("id", "text"), weights)
    return scored.select("id", in_fold(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"), "n_sentences", "offending")


def op11_toxic_sentences(spark, sf_dir):
    """Toxicity of every document, with the number and the worst of its offending sentences."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    # the largest chance, then the first place
    order = F.transform("offending", lambda x: F.struct((-x["chance"]).alias("c"), x["start"].alias("start"), x["length"].alias("length")))
    worst = F.array_min(order)
    return classify(docs, labels).select(
        F.col("id").alias("doc_id"), "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"),
        worst["start"].alias("worst_start"), worst["length"].alias("worst_length"))
