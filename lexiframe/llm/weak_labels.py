"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on each
document.  Expectation-maximisation (Dawid and Skene 1979) estimates every
labeller's accuracy for both classes from the votes alone: documents with equal
votes are one row, so the estimate needs only the counts of the vote patterns
(at most 3 ** labellers rows) over all documents.  The posterior of each
pattern labels its documents, and these labels train a linear scorer on hashed
words and word shapes, which then scores every document by its whole text.

The scorer is trained on at most about ``TRAIN_DOCS`` documents, chosen by a
hash of the id: each of ``TRAIN_PARTS`` parts makes a pass of stochastic
gradient descent and the weights are averaged after each pass (iterative
parameter mixing; McDonald et al. 2010).

Defined results: a NULL or wordless text has no score features (score from the
bias alone) and is not kept; NULL ids are scored like others; repeated rows
get equal scores; with no rows to train on the weights are 0; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.kernels import U64, blocks, mix, string_buffers, words_of
from lexiframe.llm.storage import plus, table, written

GOOD, BAD, ABSTAIN = 1, 0, -1
#: Documents of the training sample, its parts, passes, and the hashed weights.
TRAIN_DOCS, TRAIN_PARTS, PASSES, WEIGHTS = 16_384, 8, 16, 1 << 16
RATE, DECAY = 12.0, 1e-7
#: EM steps at most, and the smoothing of its counts.
EM_STEPS, SMOOTHING = 200, 1.0
#: Prior belief: a labeller votes bad on this share of good documents; the belief
#: weighs as much as this share of all documents.
FALSE_ALARMS, BELIEF = 0.01, 0.05
#: A document is kept if its score is at least this probability (losing a good one costs three times a bad one).
KEEP = 0.25

_SPACE = r"[\x20\x09-\x0D]+"


def votes(text: Column) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """Statistics of a text, and the labellers over them."""
    n = F.greatest(F.col("_n"), F.lit(1))
    stats = [
        ("_words", F.array_remove(F.split(text, _SPACE), "")),
        ("_signs", F.length(F.regexp_replace(text, r"[^#*$%&|<>{}\[\]~^_=\\]+", ""))),
        ("_glued", F.regexp_count(text, F.lit(r"[\p{L}\p{N}][#*$%&|<>{}\[\]~^_=\\!?][#*$%&|<>{}\[\]~^_=\\!?]"))),
        ("_bare", F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"))),
        ("_marks", F.length(F.regexp_replace(text, r"[^!?]+", ""))),
        ("_stops", F.length(F.regexp_replace(text, r"[^.,;:]+", ""))),
        ("_capitals", F.length(F.regexp_replace(text, r"\P{Lu}+", ""))),
        ("_chars", F.length(F.regexp_replace(text, _SPACE, ""))),
        ("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    ]
    lines, chars = F.size("_lines"), F.greatest(F.col("_chars"), F.lit(1))
    length, signs, marks = F.col("_chars") / n, F.col("_signs") / n, F.col("_marks") / n
    distinct, echo = F.col("_distinct") / n, F.col("_echo") / n
    copies = 1 - F.size(F.array_distinct("_lines")) / F.greatest(lines, F.lit(1))
    capitals, stops = F.col("_capitals") / chars, F.col("_stops") / n
    labellers = [
        ("words", F.when(F.col("_n") < 10, BAD).when(F.col("_n") >= 30, GOOD).otherwise(ABSTAIN)),
        ("signs", F.when(signs > 0.2, BAD).when(signs < 0.05, GOOD).otherwise(ABSTAIN)),
        ("marks", F.when(marks > 0.3, BAD).when(marks < 0.05, GOOD).otherwise(ABSTAIN)),
        ("capitals", F.when(capitals > 0.4, BAD).when(capitals < 0.1, GOOD).otherwise(ABSTAIN)),
        ("length", F.when((length < 2.5) | (length > 11), BAD).when((length > 3.5) & (length < 7), GOOD).otherwise(ABSTAIN)),
        ("distinct", F.when((distinct < 0.35) & (F.col("_n") >= 20), BAD).when(distinct > 0.45, GOOD).otherwise(ABSTAIN)),
        ("echo", F.when(echo > 0.2, BAD).when(echo < 0.05, GOOD).otherwise(ABSTAIN)),
        ("lines", F.when((copies > 0.3) & (lines >= 3), BAD).when((copies < 0.1) & (lines >= 3), GOOD).otherwise(ABSTAIN)),
        ("glued", F.when(F.col("_glued") / n > 0.1, BAD).when(F.col("_glued") / n < 0.02, GOOD).otherwise(ABSTAIN)),
        ("bare", F.when(F.col("_bare") / n > 0.1, BAD).when(F.col("_bare") / n < 0.03, GOOD).otherwise(ABSTAIN)),
        ("stops", F.when((stops < 0.01) & (F.col("_n") >= 30), BAD).when((stops > 0.03) & (stops < 0.6), GOOD).otherwise(ABSTAIN)),
    ]
    return stats, labellers


def with_votes(rows: DataFrame, text: str) -> DataFrame:
    """Add ``votes``: one sign per labeller ('1' good, '0' bad, '-' abstains)."""
    keep = rows.columns
    stats, labellers = votes(F.col(text))
    out = rows.withColumns(dict(stats))
    w = F.col("_words")
    same = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    out = out.withColumns({"_n": F.size(w), "_distinct": F.size(F.array_distinct(w)), "_echo": same})
    sign = [F.when(c == ABSTAIN, "-").otherwise(c.cast("string")) for _, c in labellers]
    return out.select(*keep, F.col("_n").cast("long").alias("n_words"), F.concat(*sign).alias("votes"))


def estimate(patterns: list[tuple[str, int]]) -> tuple[dict[str, float], dict]:
    """EM over counts of vote patterns: the posterior of 'good' for every
    pattern, and the model (prior, per labeller the chances of its votes)."""
    if not patterns:
        return {}, {"prior": 0.5, "chances": np.zeros((0, 2, 3))}
    signs = np.array([["0-1".index(c) for c in p] for p, _ in sorted(patterns)])
    count = np.array([c for _, c in sorted(patterns)], dtype=float)
    # start: any bad vote makes a document suspicious
    good = np.where((signs == 0).any(axis=1), 0.1, 0.9)
    onehot = np.eye(3)[signs]  # pattern, labeller, vote
    chances, prior = None, 0.5
    for _ in range(EM_STEPS):
        weight = np.stack([count * (1 - good), count * good])  # class, pattern
        seen = np.einsum("cp,plv->lcv", weight, onehot) + SMOOTHING
        seen[:, 1, 0] += BELIEF * count.sum() * FALSE_ALARMS
        seen[:, 1, 2] += BELIEF * count.sum() * (1 - FALSE_ALARMS)
        chances = seen / seen.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + SMOOTHING) / (weight.sum() + 2 * SMOOTHING)
        likely = np.einsum("plv,lcv->pc", onehot, np.log(chances)) + np.log([1 - prior, prior])
        now = 1 / (1 + np.exp(np.clip(likely[:, 0] - likely[:, 1], -500, 500)))
        done = np.abs(now - good).max() < 1e-9
        good = now
        if done:
            break
    return dict(zip((p for p, _ in sorted(patterns)), good.tolist(), strict=True)), {"prior": prior, "chances": chances}


# byte classes of a word's shape: letter, capital, digit, and each other byte by itself
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def block_features(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
    """Hashed features of each word of a block: its slots for the word, its
    shape, and whether it repeats the word before, one row per word; a shape is
    the word with runs of letters, capitals and digits (and of equal signs)
    written once."""
    w = words_of(raw, offsets, lo, hi, lower=True)
    if not len(w.hash):
        return w, np.zeros((0, 3), np.int64)
    shape = _SHAPE[w.data]
    # shapes as texts of their own: bytes equal to the one before in the same word go
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.start] = True
    white = (w.data == 32) | ((w.data >= 9) & (w.data <= 13))
    keep |= white
    place = np.cumsum(keep) - keep
    s = words_of(np.where(white, np.uint8(32), shape)[keep], np.append(place, keep.sum())[w.doc_byte], 0, hi - lo)
    echo = np.zeros(len(w.hash), dtype=U64)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    slots = np.stack([mix(w.hash + U64(1)), mix(s.hash + U64(2)), mix(echo + U64(3))], axis=1) % U64(WEIGHTS)
    slots = slots.astype(np.int64)
    return w, slots


def _training_rows(batches):
    for batch in batches:
        raw, offsets = string_buffers(batch.column("text"))
        for lo, hi in blocks(offsets):
            w, slots = block_features(raw, offsets, lo, hi)
            slot, share = [], []
            for i in range(hi - lo):
                mine = slots[w.first[i]: w.first[i + 1]].ravel()
                s, c = np.unique(mine, return_counts=True)
                slot.append(s.astype(np.int32))
                share.append((c / max(len(mine), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(lo, hi - lo), batch.column("good").slice(lo, hi - lo),
                 pa.array(slot, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                names=["key", "good", "slots", "shares"])


def train(sample: DataFrame) -> np.ndarray:
    """Weights (and the bias, last) from rows ``(key, good, text)``."""
    rows = written(sample.mapInArrow(_training_rows, "key long, good double, slots array<int>, shares array<float>"), "train")
    rows = written(rows.repartition(TRAIN_PARTS, "key").sortWithinPartitions("key"), "train")
    weights = np.zeros(WEIGHTS + 1)
    for step in range(PASSES):
        start, rate = weights.tobytes(), RATE / (1 + step / 4)

        def descend(batches, start=start, rate=rate):
            w = np.frombuffer(start).copy()
            n = 0
            for batch in batches:
                good = batch.column("good").to_numpy()
                slots, shares = batch.column("slots"), batch.column("shares")
                for i in range(batch.num_rows):
                    at, x = slots[i].values.to_numpy(), shares[i].values.to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))
                    g = rate * (p - good[i])
                    w[at] -= g * x + rate * DECAY * w[at]
                    w[-1] -= 0.1 * g
                    n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "w"])

        parts = rows.mapInArrow(descend, "n long, w binary").collect()  # at most one row per file of the bounded sample
        total = sum(r["n"] for r in parts)
        if total:
            weights = sum(np.frombuffer(r["w"]) * (r["n"] / total) for r in sorted(parts, key=lambda r: bytes(r["w"])))
    return weights


def score(rows: DataFrame, text: str, weights: np.ndarray, out: str = "score") -> DataFrame:
    """Replace ``text`` by the scorer's probability that the document is good."""
    keep = [c for c in rows.columns if c != text]
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # WEIGHTS + 1 numbers

    def run(batches):
        w = shared.value
        for batch in batches:
            raw, offsets = string_buffers(batch.column(text))
            out_scores = np.zeros(batch.num_rows)
            for lo, hi in blocks(offsets):
                words, slots = block_features(raw, offsets, lo, hi)
                value = w[slots].mean(axis=1) if len(slots) else np.zeros(0)
                total = np.bincount(words.doc, weights=value, minlength=hi - lo)
                count = np.maximum(np.diff(words.first), 1)
                out_scores[lo:hi] = 1 / (1 + np.exp(-np.clip(total / count + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out_scores)], names=[*keep, out])

    return rows.mapInArrow(run, plus(rows.select(*keep).schema, **{out: "double"}))


def classify(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_words, votes, posterior, score, kept)`` of every document."""
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    voted = written(with_votes(keyed, "text").select("id", F.xxhash64("id", "text").alias("key"), "n_words", "votes"), "votes")
    counts = [(r["votes"], r["count"]) for r in voted.groupBy("votes").count().collect()]  # at most 3 ** labellers rows
    posterior, _ = estimate(counts)
    spark = docs.sparkSession
    known = written(spark.createDataFrame(list(posterior.items()), "votes string, posterior double"), "patterns")
    rows = voted.agg(F.count("*")).first()[0]
    share = min(1.0, TRAIN_DOCS / max(rows, 1))
    chosen = F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    picked = keyed.withColumn("key", F.xxhash64("id", "text")).filter(chosen)
    labels = voted.filter(chosen).select("key", "votes").distinct().join(known, "votes").select("key", F.col("posterior").alias("good"))
    weights = train(picked.join(labels, "key").select("key", "good", "text"))
    scored = score(keyed.select("id", F.xxhash64("id", "text").alias("key"), "text"), "text", weights)
    # votes are a function of the text: small rows meet by its hash
    seen = voted.select("key", "n_words", "votes").distinct().join(known, "votes")
    scored = scored.join(seen, "key").select("id", "n_words", "votes", "posterior", "score")
    return scored.withColumn("kept", (F.col("score") >= KEEP) & (F.col("n_words") > 0))


def op1_weak_label_quality(spark, sf_dir):
    """Votes, posterior, score and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
