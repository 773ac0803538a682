"""Toxic sentences: features and scores against plain Python, learning on planted words, places."""

import math
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from lexiframe.llm import toxic_sentences as ts
from lexiframe.llm.kernels import string_buffers
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sentences(text):
    """``(start, length, words)`` of the sentences of a text, in code points."""
    out = []
    for m in re.finditer(r"[^.!?\n]+", text):
        words = list(re.finditer("[A-Za-z\u0080-\U0010ffff]+", m.group()))
        if words:
            out.append((m.start() + words[0].start(), words[-1].end() - words[0].start(), {w.group().encode().translate(LOWER) for w in words}))
    return out


def features(word):
    """Slots of one word through a one-word document."""
    raw, offsets = string_buffers(pa.array([word.decode("utf-8")]))
    w, _, _, fresh = ts.block_sentences(raw, offsets, 0, 1)
    slots = ts.slots_of(w, np.flatnonzero(fresh))[0]
    assert (slots < ts.WEIGHTS).sum() == 1 + sum(len(word) > k for k in ts.BEGINNINGS)
    return slots[slots < ts.WEIGHTS]


def plain(text, weights):
    spans, miss = [], 1.0
    for start, length, words in sentences(text or ""):
        z = weights[-1] + sum(weights[features(w)].sum() for w in words)
        p = 1 / (1 + math.exp(-z))
        miss *= 1 - p
        if p >= ts.OFFENDING:
            spans.append((start, length, p))
    return 1 - miss, spans


TEXTS = ["You are an IDIOT! Fine day. idiot idiot", "été Été ÉTÉ. naïve?\n\n... !", "", " \n", "one", "#idiot$$$ and*** 12idiot34. x", "ß" * 30 + ". 漢字 idiotic", None,
         "no end " * 500 + ". ok", "idiot\nidiot\nidiot"]


def test_scores_and_places_against_plain_python(spark):
    rnd = np.random.default_rng(1)
    weights = np.r_[np.abs(rnd.normal(size=ts.WEIGHTS)) * (rnd.random(ts.WEIGHTS) < 0.3), -2.0]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for r in ts.score(rows, weights).collect():
        score, spans = plain(TEXTS[r["id"]], weights)
        assert math.isclose(r["score"], score, abs_tol=1e-9)
        assert [(s["start"], s["length"]) for s in r["offending"]] == [s[:2] for s in spans]
        assert np.allclose([s["chance"] for s in r["offending"]], [s[2] for s in spans])
        assert r["n_sentences"] == len(sentences(TEXTS[r["id"]] or ""))


def test_a_step_follows_the_likelihood():
    """The gradient of a step equals a numerical one of the noisy-or likelihood."""
    slots, places = np.array([1, 2, 3, 1, 4]), np.array([0, 0, 1, 2, 2])
    for toxic in (0, 1):
        def loss(w, toxic=toxic):
            z = np.bincount(places, weights=w[slots]) + w[-1]
            whole = 1 - np.prod(1 - 1 / (1 + np.exp(-z)))
            return -math.log(whole if toxic else 1 - whole)

        w = ts.first_weights()
        w[1:5], w[-1] = [0.3, 0.6, 0.2, 0.9], -1.0
        squares, after = np.zeros(ts.WEIGHTS + 1), w.copy()
        ts.descend(after, squares, toxic, slots, places)
        for f in (2, 3, 4):
            step = np.zeros_like(w)
            step[f] = 1e-6
            slope = (loss(w + step) - loss(w - step)) / 2e-6
            assert math.isclose(after[f], max(0.0, w[f] - ts.RATE * slope / math.sqrt(slope ** 2 + ts.DAMPING)), rel_tol=1e-4)


def corpus(n):
    rnd = random.Random(3)
    bad = ["vilest", "rotten", "scummy"]
    rows, labels, planted = [], [], {}
    for i in range(n):
        lines = [" ".join(f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(rnd.randrange(3, 12))) for _ in range(rnd.randrange(1, 12))]
        toxic = rnd.random() < 0.2
        if toxic:
            planted[i] = rnd.randrange(len(lines))
            lines[planted[i]] += " " + rnd.choice(bad)
        rows.append((i, ". ".join(lines)))
        labels.append((i, int(toxic)))
    return rows, labels, planted


def test_held_out_documents_and_their_sentences(spark):
    rows, labels, planted = corpus(1500)
    docs = clashing(documents(spark, rows)).select(F.col("doc_id").alias("id"), "text")
    got = {r["id"]: r for r in ts.classify(docs, spark.createDataFrame(labels, "id long, toxic int")).collect()}
    assert len(got) == 1500
    held = [i for i, _ in labels if crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _ in labels)
    right = sum(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert right >= 0.97 * len(held)
    for i in held:
        if i in planted and got[i]["predicted"]:
            want = sentences(rows[i][1])[planted[i]]
            assert want[:2] in [(s["start"], s["length"]) for s in got[i]["offending"]]


def test_held_out_labels_do_not_matter(spark):
    rows, labels, _ = corpus(300)
    docs = documents(spark, rows).select(F.col("doc_id").alias("id"), "text")
    other = [(i, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = ({(r["id"], r["score"]) for r in ts.classify(docs, spark.createDataFrame(x, "id long, toxic int")).collect()} for x in (labels, other))
    assert a == b


def test_nulls_repeats_empty_tables_and_long_texts(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "id long, toxic int")
    rows = [(None, "same text"), (None, "same text"), (1, None), (1, ""), (3, "calm words here"), (3, "calm words here"), (4, "word. " * 100_000), (5, "x" * 300_000)]
    docs = documents(spark, rows).select(F.col("doc_id").alias("id"), "text")
    got = ts.classify(docs, labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["id"] == 1) and not any(r["held_out"] for r in got if r["id"] is None)
    assert len({r["score"] for r in got if r["id"] == 3}) == 1
    assert ts.classify(documents(spark, []).select(F.col("doc_id").alias("id"), "text"), labels).count() == 0
    none = spark.createDataFrame([], "id long, toxic int")
    assert {r["predicted"] for r in ts.classify(docs, none).collect()} <= {0, 1}
