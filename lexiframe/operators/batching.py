"""Model-input batches: token ids from a fitted vocabulary, truncation,
padding to the batch maximum and attention masks.

A batch holds at most ``batch_size`` rows, so every per-batch window below
works on a bounded group whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions.text import attention_mask, pad_to, truncate, word_tokens

# Reserved ids of the built-in vocabulary.
PAD_ID = 0
UNK_ID = 1
FIRST_TERM_ID = 2


def pieces(batches, rows: int):
    """Arrow batches cut to at most ``rows`` rows, so that a task's Python holds few at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def token_ids(df: DataFrame, key: str, vocab: DataFrame, text: str = "text", out: str = "input_ids") -> DataFrame:
    """Whole-text token ids: ``term_id + 2`` for known tokens, 1 for unknown ones.

    Tokens are exploded with their position, looked up in the vocabulary (a
    join on token; AQE broadcasts a small vocabulary and splits hot-token
    partitions of a large one) and gathered back per row in position order.
    A row's ids are bounded by its own length.
    """
    toks = df.select(key, F.posexplode(word_tokens(text)).alias("_lf_i", "token"))
    ids = (toks.join(vocab.select("token", "term_id"), "token", "left")
           .select(key, "_lf_i", F.coalesce(F.col("term_id") + FIRST_TERM_ID, F.lit(UNK_ID)).cast("int").alias("_lf_id")))
    packed = ids.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_lf_i", "_lf_id"))).alias("_lf_p"))
    packed = packed.select(key, F.transform("_lf_p", lambda s: s["_lf_id"]).alias(out))
    return (df.select(key).join(packed, key, "left")
            .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<int>"))))


def batch_max_length(df: DataFrame, batch: str, seq: str, out: str = "batch_max_len") -> DataFrame:
    return df.withColumn(out, F.max(F.size(seq)).over(Window.partitionBy(batch)))


def pad_batches(df: DataFrame, batch: str, ids: str = "input_ids", max_length: int | None = 512,
                pad_id: int = PAD_ID) -> DataFrame:
    """Truncate to ``max_length`` (None: no truncation), pad every row to its
    batch's longest sequence and add the attention mask."""
    t = df.withColumn(ids, truncate(ids, max_length))
    t = batch_max_length(t, batch, ids, "_lf_m")
    return (t.withColumn("attention_mask", attention_mask(ids, F.col("_lf_m")))
            .withColumn(ids, pad_to(ids, F.col("_lf_m"), pad_id))
            .drop("_lf_m"))


def tokenize_with(df: DataFrame, text: str, make_tokenizer, max_length: int | None = 512,
                  out: str = "input_ids") -> DataFrame:
    """Plug-in tokenizer seam: ``make_tokenizer()`` returns ``encode(list[str])
    -> list[list[int]]`` and is called once per Python worker; texts arrive in
    Arrow batches through an iterator pandas UDF.  Truncation to
    ``max_length`` (None: none) happens after encoding the whole text."""
    from collections.abc import Iterator

    import pandas as pd

    def encode(batches):
        tok = make_tokenizer()
        for s in batches:
            ids = tok(s.fillna("").tolist())
            if max_length is not None:
                ids = [x[:max_length] for x in ids]
            yield pd.Series(ids)

    # Real type objects (this module uses postponed annotations) select the
    # iterator-of-series UDF form.
    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(encode, "array<int>")
    return df.withColumn(out, udf(F.col(text)))
