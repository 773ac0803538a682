"""The translation memory: what is sent, what is kept after a failure, what rows get."""

import os

import pyarrow.parquet as pq
import pytest

from lexiframe.operators import translation_memory as tm
from lexiframe.session import scratch_root

LANGS = ["es", "de"]


def logging_translator(folder, fail_after=None):
    """Marks texts, and writes one file per request with what it was sent."""
    def translate(texts, lang):
        if fail_after is not None and len(os.listdir(folder)) >= fail_after:
            raise RuntimeError("client is down")
        with open(os.path.join(folder, f"{lang}-{os.urandom(6).hex()}"), "w", encoding="utf-8") as f:
            f.write("\x00".join(texts))
        return [f"[{lang}] {t}" for t in texts]

    return translate


def sent(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out.append((name.split("-")[0], f.read().split("\x00")))
    return out


@pytest.fixture()
def rows(spark):
    texts = [f"text {i % 70}" for i in range(200)] + [None, "", ""]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), texts


def test_equal_texts_once_and_nothing_again(spark, tmp_dir, rows):
    df, texts = rows
    log, memory = f"{tmp_dir}/log", f"{tmp_dir}/memory"
    os.makedirs(log)
    out, n = tm.translate_with_memory(df, "text", LANGS, logging_translator(log), memory)
    got = {r["id"]: (r["text"], r["augmented_es"], r["augmented_de"]) for r in out.collect()}
    assert got == {i: (t, *((None, None) if t is None else (f"[es] {t}", f"[de] {t}"))) for i, t in enumerate(texts)}
    requests = sent(log)
    assert n == 2 * 71 and all(len(r) <= 32 for _, r in requests)
    assert sorted(t for lang, r in requests for t in r if lang == "es") == sorted({t for t in texts if t is not None})
    again, n = tm.translate_with_memory(df, "text", LANGS, logging_translator(log), memory)
    assert n == 0 and len(sent(log)) == len(requests) and again.count() == len(texts)
    more = spark.createDataFrame([(1, "text 3"), (2, "new")], "id long, text string")
    assert tm.translate_with_memory(more, "text", ["es", "fr"], logging_translator(log), memory)[1] == 3


def test_a_failed_run_goes_on_after_its_last_page(spark, tmp_dir, rows):
    df, texts = rows
    log, memory = f"{tmp_dir}/log", f"{tmp_dir}/memory"
    os.makedirs(log)
    with pytest.raises(Exception, match="client is down"):
        tm.fill_memory(df, "text", LANGS, logging_translator(log, fail_after=4), memory, page_texts=30)
    kept = tm.open_memory(spark, memory).count()
    assert 0 < kept < 2 * 71
    assert tm.fill_memory(df, "text", LANGS, logging_translator(log), memory, page_texts=30) == 2 * 71 - kept
    entries = tm.open_memory(spark, memory)
    assert entries.count() == entries.select("lang", "key").distinct().count() == 2 * 71


def test_wrong_number_of_texts_and_empty_table(spark, tmp_dir, rows):
    with pytest.raises(Exception, match="returned 0 texts"):
        tm.fill_memory(rows[0], "text", LANGS, lambda texts, lang: [], f"{tmp_dir}/m")
    empty = rows[0].filter("id < 0")
    out, n = tm.translate_with_memory(empty, "text", LANGS, lambda texts, lang: texts, f"{tmp_dir}/n")
    assert n == 0 and out.count() == 0 and out.columns == ["id", "text", "augmented_es", "augmented_de"]


def test_pages_go_after_their_commit_and_the_memory_is_compressed(spark, tmp_dir, rows):
    df, memory = rows[0], f"{tmp_dir}/memory"
    kept = scratch_root(spark).removeprefix("file:")
    before = {x for x in os.listdir(kept) if x.startswith("pages-")} if os.path.isdir(kept) else set()
    assert tm.fill_memory(df, "text", LANGS, lambda texts, lang: texts, memory, page_texts=30) == 2 * 71
    with pytest.raises(Exception, match="returned 0 texts"):
        tm.fill_memory(df, "text", ["fr"], lambda texts, lang: [], memory)
    assert {x for x in os.listdir(kept) if x.startswith("pages-")} == before
    assert {pq.ParquetFile(f"{memory}/{x}").metadata.row_group(0).column(2).compression for x in os.listdir(memory) if x.endswith(".parquet")} == {"ZSTD"}


def test_entries_of_a_key_move_together_and_the_smallest_counts(spark, tmp_dir):
    memory = f"{tmp_dir}/memory"
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "é")], "id long, `the text` string").withColumnRenamed("the text", "text")
    entries = [("es", "a", "ñ2"), ("es", "a", "z1"), ("de", "a", None), ("es", "é", "ü"), ("de", "é", "x"), ("fr", "a", "other")]
    for part in (entries[:1], entries[1:]):
        spark.createDataFrame(part, "lang string, text string, translated string").select(
            "lang", tm._key("text").alias("key"), "translated").coalesce(1).write.mode("append").parquet(memory)
    out, n = tm.translate_with_memory(texts, "text", LANGS, lambda texts, lang: texts, memory)
    assert n == 0 and sorted(out.collect()) == [(1, "a", "z1", None), (2, "a", "z1", None), (3, None, None, None), (4, "é", "ü", "x")]
