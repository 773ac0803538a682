"""The filter audit against a loop over documents and orders, and its SQL."""

import itertools
import random
import re

from lexiframe.llm import filter_audit
from pyspark.sql import functions as F

from tests.llm.helpers import WORD, clashing, documents

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """``rows`` are ``(doc_id, text, lang, source)``."""
    known = {}
    for d, q, t in labels:
        if d is not None:
            was = known.get(d, (False, False))
            known[d] = (was[0] or q == 1, was[1] or t == 1)
    first = {}
    for d, t, _, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out, failing = {}, []
    for d, t, _, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        failing.append((s or "", {f for f, v in fails.items() if v}, *known.get(d, (False, False))))
    for part in {f[0] for f in failing}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = [f for f in failing if f[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in alive if f in x[1]]
                again = sum(f in x[1] for x in gone)
                alive = [x for x in alive if f not in x[1]]
                gone += hit
                shapley[f] += len(hit)
                alone = sum(x[0] == part and x[1] == {f} for x in failing)
                out[part, "".join(order), step] = [len(alive), len(hit), again, alone, sum(x[2] for x in hit), sum(x[3] for x in hit), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {(*k, *v) for k, v in out.items()}


def result(spark, rows, labels, extra=False):
    docs = documents(spark, rows)
    docs = clashing(docs).withColumn("hash", F.lit(1)).withColumn("mask", F.lit("x")) if extra else docs
    docs = docs.select("*", F.col("doc_id").alias("_id")) if extra else docs
    ready = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    known = spark.createDataFrame(labels, LABELS).select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    got = filter_audit.audit(ready, known).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def corpus(n=120):
    rnd = random.Random(5)
    texts = []
    for _ in range(n):
        w = [f"w{rnd.randrange(rnd.choice([20, 5000]))}" for _ in range(rnd.choice([3, 49, 50, 60, 80]))]
        t = rnd.choice([" ", "\n", "\x0b "]).join(w)
        t += rnd.choice(["", "", " # mark", " ABCDEFGHIJKLMNOP" * 3])
        texts.append(t)
    texts += [None, "", "É" * 60, " ", "only"]
    rows = [(i, rnd.choice(texts), "en", rnd.choice(["a", "b", None, "", "hot", "hot", "hot"])) for i in range(2 * n)]
    rnd.shuffle(rows)
    return rows


def test_against_a_loop(spark):
    rows = corpus() + [(None, "same", "en", "a"), (None, "same", "en", "a"), (7, "same", "en", "a"), (7, "other", "en", "b"), (500, "same", "en", "c")]
    labels = [(i, i % 2, i % 3) for i in range(0, 200, 3)] + [(6, None, 1), (6, 1, None), (None, 1, 1)]
    assert result(spark, rows, labels) == brute(rows, labels)
    assert result(spark, rows, labels, extra=True) == brute(rows, labels)


def test_hot_text_is_dealt_over_salts(spark):
    rows = [(i, "one text of everyone", "en", "s") for i in range(1500)] + [(i, f"own {i % 700}", "en", "s") for i in range(1500, 3000)]
    assert result(spark, rows, []) == brute(rows, [])


def test_long_text_and_empty_table(spark):
    rows = [(2, "word " * 200_000, "en", "s"), (1, "word " * 200_000, "en", "s"), (3, "x" * 1_000_000, "en", "s")]
    assert result(spark, rows, [(2, 1, 1)]) == brute(rows, [(2, 1, 1)])
    assert result(spark, [], []) == set()


def test_every_text_may_be_equal_for_null_sources(spark):
    rows = [(i, None, None, None) for i in range(4)]
    assert result(spark, rows, []) == brute(rows, [])
