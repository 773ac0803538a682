"""Small fixtures of the training-data tests."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
#: Columns whose names the operators use themselves.
CLASHES = ["id", "n", "node", "kept", "row", "_row", "_text", "words", "part", "length", "key", "votes", "shard", "slot", "n_words"]


def documents(spark, rows):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def words(rnd, n, size=20_000):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def text(seed, n, size=20_000):
    return " ".join(words(random.Random(seed), n, size))


def shingle_set(t, k=3):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def saved(df, folder):
    """A folder of tables as the queries read them."""
    df.write.parquet(f"{folder}/documents.parquet")
    return folder
