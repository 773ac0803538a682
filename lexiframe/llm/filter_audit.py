"""Interaction audit of ordered filters.

Five filters A to E fail documents.  A to D look at one text; E is an existential
self-join: a left-semi join on (hash, exact text) with a smaller doc_id marks the
documents that repeat an earlier one.  The failures of all filters are united by
document, documents with the same combination of failures are counted, and these
counts (at most 32 per part) give every number of every order of the filters: a
document is removed at the first step whose filter it fails.

Scale: texts are read twice and leave their task only where their hash repeats.
The smaller side of the semi join holds one row per repeated text (its smallest
doc_id, pre-aggregated in each task), and a hash that holds more than a
``HOT_SHARE`` of all rows is dealt over ``SALTS`` tasks, so no group of copies lands
in one task.

Defined results: a NULL text counts as empty; a NULL doc_id is never smaller than
another nor has a smaller one, so such a row passes E and never makes another row
fail it; rows that share an id and a text are separate documents with equal
verdicts, and neither is smaller; a NULL source is the part ''; documents
without labels are neither good nor toxic, and of several labels of an id any 1
counts; an empty table gives no rows; very long texts are judged whole; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.storage import table, written

FILTERS = "ABCDE"
#: A hash with more than this share of all rows is hot (so at most 256 are) and is dealt over this many salts.
HOT_SHARE, SALTS = 1 / 256, 64

_SPACE = r"[\x20\x09-\x0D]+"


def own_failures(text) -> dict:
    """Failure conditions A to D of a text."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def earlier_copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(id, hash, part)`` of the documents whose text a smaller id has too.

    ``docs`` holds ``id, text, part``; ``rows`` the same rows without texts, with
    ``hash``, written before."""
    counts = rows.filter("id is not null").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(counts, "repeated")
    total = rows.agg(F.count("*")).first()[0]
    hot = [r["hash"] for r in repeated.filter(F.col("n") > max(1000, int(total * HOT_SHARE))).select("hash").collect()]  # at most 256
    salts = F.when(F.col("hash").isin(hot), F.lit(SALTS)).otherwise(F.lit(1)) if hot else F.lit(1)
    dealt = F.explode(F.sequence(F.lit(0), salts - 1))
    salted = docs.filter("id is not null").withColumn("hash", F.xxhash64("text")).withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    # the planner broadcasts the repeated hashes only if their written table is small
    copies = written(salted.join(repeated.select("hash", dealt.alias("salt")), ["hash", "salt"], "left_semi"), "copies")
    first = copies.groupBy("hash", "text").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = first.select(F.col("hash").alias("h"), F.col("text").alias("t"), "first", dealt.alias("s"))
    on = (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")) & (F.col("text") == F.col("t")) & (F.col("first") < F.col("id"))
    return copies.join(first, on, "left_semi").select("id", "hash", "part").distinct()


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part and combination of
    failures; bit i of ``mask`` is filter i.

    ``docs`` holds ``id, text, part``; ``labels`` holds ``id, good, toxic``."""
    bits = sum((F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(F.lit(0)) for f, c in own_failures(F.col("text")).items()), F.lit(0))
    rows = written(docs.select("id", "part", F.xxhash64("text").alias("hash"), bits.alias("mask")), "failures")
    late = earlier_copies(docs, rows)
    own = rows.select("id", "hash", "part", "mask", F.lit(0).alias("late"), F.lit(1).alias("n"))
    marks = late.select("id", "hash", "part", F.lit(0).alias("mask"), F.lit(1).alias("late"), F.lit(0).alias("n"))
    # rows without an id share the group of their text and part: partial sums, one row per task
    united = own.unionByName(marks).groupBy("id", "hash", "part").agg(F.max("mask").alias("mask"), F.max("late").alias("late"), F.sum("n").alias("n"))
    known = labels.filter("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    judged = united.join(known, "id", "left").withColumn("mask", F.col("mask") + F.lit(1 << FILTERS.index("E")) * F.col("late"))
    return judged.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def fates(size: int = len(FILTERS)) -> list[tuple]:
    """What each step of each order does to a document with each combination of
    failures: ``(mask, filter_order, step, kept, removed, redundant, alone, share)``;
    ``share`` counts the orders in which the step's filter is the one that removes it."""
    out = []
    orders = list(permutations(range(size)))
    for mask in range(1 << size):
        failing = bin(mask).count("1")
        for order in orders:
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << f
                fails, gone = bool(mask & bit), bool(mask & before)
                out.append((mask, "".join(FILTERS[i] for i in order), step, int(not fails and not gone), int(fails and not gone),
                            int(fails and gone), int(mask == bit), len(orders) // failing if fails else 0))
                before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the contract."""
    spark = docs.sparkSession
    counted = written(combinations(docs, labels), "combinations")
    # a fixed table of 32 * 600 rows, whatever the input
    rules = spark.createDataFrame(fates(), "mask int, filter_order string, step int, k int, r int, d int, u int, w int")
    met = counted.join(F.broadcast(rules), "mask")
    sums = {"kept": "k", "removed": "r", "redundant": "d", "unique_fails": "u", "shapley": "w"}
    return met.groupBy("part", "filter_order", "step").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(name) for name, c in sums.items()],
        F.sum(F.col("good") * F.col("r")).alias("good_lost"), F.sum(F.col("toxic") * F.col("r")).alias("toxic_lost"))


def op12_filter_interactions(spark, sf_dir):
    """The audit of ``documents`` by source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    return audit(docs, labels)


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), words AS (
  SELECT doc_id, text, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), firsts AS (
  SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), failures AS (
  SELECT words.doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(words.text, '[^A-Z]+', '', 'g')) > 5 * length(words.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < words.doc_id THEN 16 ELSE 0 END AS mask
  FROM words JOIN firsts ON words.text = firsts.text
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failures LEFT JOIN known ON failures.doc_id = known.doc_id GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, list_sum(list_concat([0], bits[1:s - 1])) AS before FROM orders, range(1, 6) r(s)
), results AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit)::INT = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INT <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INT = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM results
"""
