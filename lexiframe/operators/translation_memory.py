"""Translation through a memory: no text is sent twice.

The memory is a folder of Parquet files, ``(lang, key, translated)`` with the key the
SHA-256 of a text.  A run takes the keys of a table's distinct texts, leaves out those
the memory has for a language, moves the texts that are left once for all languages, and
sends them in requests of ``chunk`` texts, in each task in the order of their keys.  Requests are dealt into pages of about
``page_texts`` texts; a page's results are committed to the memory before the next
page starts and before any is used, so a run that fails goes on after the last whole
page.  Rows then take their translations from the memory by key.

Only texts that are new cost a request, equal texts cost one, and a request is sent
again only if its page failed before its commit.

Defined results: NULL texts are not sent and have NULL translations; empty texts
are texts; a translator that returns another number of texts is an error; equal
entries of a memory that two runs filled at once count once (the smallest).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators.augment import PIECE_CHUNKS, TRANSLATE_CHUNK
from lexiframe.operators.batching import pieces
from lexiframe.session import cut_lineage, scratch_path

_SCHEMA = "lang string, key string, translated string"
#: Texts of a page, at most about; how the memory and its pages are compressed (a memory holds each text once per language).
PAGE_TEXTS, CODEC = 1_000_000, "zstd"


def open_memory(spark: SparkSession, path: str) -> DataFrame:
    """The entries; a memory that was never written is empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(_SCHEMA).parquet(path) if known else spark.createDataFrame([], _SCHEMA)


def _key(text):
    return F.sha2(F.col(text).cast("string"), 256)


def missing(df: DataFrame, text: str, langs: Sequence[str], path: str) -> DataFrame:
    """``(key, langs)``: keys of the distinct texts with the languages that the memory lacks; no text moves."""
    keys = df.filter(F.col(text).isNotNull()).select(_key(text).alias("key")).distinct()
    have = open_memory(df.sparkSession, path).select("lang", "key").groupBy("key").agg(F.collect_set("lang").alias("have"))
    wanted = F.array(*[F.lit(x) for x in langs]).cast("array<string>")
    lacking = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
    return keys.join(have, "key", "left").select("key", lacking.alias("langs")).filter(F.size("langs") > 0)


def _requests(translate, chunk):
    def run(batches):
        held: dict[str, list[tuple[str, str]]] = {}

        def send(lang):
            rows = held.pop(lang)
            got = list(translate([r[1] for r in rows], lang))
            if len(got) != len(rows):
                raise ValueError(f"translator returned {len(got)} texts for {len(rows)}")
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([r[0] for r in rows]), pa.array(got, pa.string())],
                                              names=["lang", "key", "translated"])

        for piece in pieces(batches, PIECE_CHUNKS * chunk):
            for key, text, langs in zip(*(piece.column(c).to_pylist() for c in ("key", "text", "langs")), strict=True):
                for lang in langs:
                    held.setdefault(lang, []).append((key, text))
                    if len(held[lang]) == chunk:
                        yield send(lang)
        for lang in sorted(held):
            yield send(lang)

    return run


def fill_memory(df: DataFrame, text: str, langs: Sequence[str], translate: Callable[[list[str], str], list[str]], path: str,
                chunk: int = TRANSLATE_CHUNK, page_texts: int = PAGE_TEXTS) -> int:
    """Send what is missing, page by page; the number of texts sent."""
    sent = _filled(df, text, langs, translate, path, chunk, page_texts)
    if sent:
        # the files of its exchanges go once the driver's objects are collected
        df.sparkSession.sparkContext._jvm.System.gc()
    return sent


def _filled(df, text, langs, translate, path, chunk, page_texts) -> int:
    spark = df.sparkSession
    todo = cut_lineage(missing(df, text, langs, path), "untranslated")
    n = todo.agg(F.coalesce(F.sum(F.size("langs")), F.lit(0))).first()[0]
    if not n:
        return 0
    pages = -(-n // page_texts)
    folder = scratch_path(spark, "pages")
    # every text moves once, to its key; a task's texts are written in the order of their keys
    texts = df.filter(F.col(text).isNotNull()).select(_key(text).alias("key"), F.col(text).alias("text"))
    one = todo.join(texts.groupBy("key").agg(F.first("text").alias("text")), "key").withColumn("page", F.pmod(F.xxhash64("key"), F.lit(pages)))
    one.sortWithinPartitions("page", "key").write.partitionBy("page").option("compression", CODEC).parquet(folder)
    dealt = spark.read.parquet(folder)
    try:
        for page in range(pages):
            rows = dealt.filter(F.col("page") == page).select("key", "text", "langs")
            rows.mapInArrow(_requests(translate, chunk), _SCHEMA).write.mode("append").option("compression", CODEC).parquet(path)
    finally:
        # what is not committed is dealt anew by the next run
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return n


def _bundled(batches):
    """``(key, bundle)``: a batch's entries of a key, compressed together."""
    for batch in batches:
        held: dict[str, list] = {}
        for lang, key, got in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "translated")), strict=True):
            held.setdefault(key, []).append((lang, got))
        bundles = []
        for entries in held.values():
            plain = json.dumps(entries, ensure_ascii=False).encode()
            bundles.append(len(plain).to_bytes(8, "little") + pa.compress(plain, codec=CODEC, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(bundles, pa.binary())], names=["key", "bundle"])


def _translations(langs: Sequence[str]):
    """Column expression: the smallest entry of each language in bundles of a key."""
    def of(bundles: pa.Array) -> pa.Array:
        out = []
        for some in bundles.to_pylist():
            best: dict[str, str] = {}
            for bundle in some or []:
                size = int.from_bytes(bundle[:8], "little")
                for lang, got in json.loads(pa.decompress(bundle[8:], decompressed_size=size, codec=CODEC, asbytes=True)):
                    if got is not None and (lang not in best or got.encode() < best[lang].encode()):
                        best[lang] = got
            out.append([best.get(x) for x in langs])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(of, "array<string>")


def translate_with_memory(df: DataFrame, text: str, langs: Sequence[str], translate: Callable[[list[str], str], list[str]], path: str,
                          chunk: int = TRANSLATE_CHUNK, prefix: str = "augmented_", page_texts: int = PAGE_TEXTS) -> tuple[DataFrame, int]:
    """``df`` with one column per language, and how many texts were sent."""
    sent = fill_memory(df, text, langs, translate, path, chunk, page_texts)
    if not langs:
        return df, sent
    # a key's entries cross the exchange compressed together
    entries = open_memory(df.sparkSession, path).filter(F.col("lang").isin(*langs))
    bundles = entries.mapInArrow(_bundled, "key string, bundle binary").groupBy(F.col("key").alias("_lf_key")).agg(F.collect_list("bundle").alias("_lf_bundles"))
    joined = df.withColumn("_lf_text_key", _key(text)).join(bundles, F.col("_lf_text_key") == F.col("_lf_key"), "left")
    read = joined.withColumn("_lf_got", _translations(list(langs))("_lf_bundles"))
    return read.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_lf_got")[i].alias(f"{prefix}{x}") for i, x in enumerate(langs)]), sent
