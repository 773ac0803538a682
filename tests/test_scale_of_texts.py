"""Texts are held in small pieces and moved no more often than needed."""

import os

import pyarrow as pa

from lexiframe.operators import augment as aug
from lexiframe.operators import translation_memory as tm
from lexiframe.operators.batching import pieces, token_ids
from lexiframe.operators.perfect_vocabulary import PIECE_ROWS, PerfectVocabulary
from lexiframe.plans import queries_vectors as qv
from lexiframe.plans.common import SplitFeatures
from tests.conftest import SF_SMALL


def test_translations_of_a_batch_are_made_in_pieces(spark, tmp_dir):
    log = f"{tmp_dir}/log"

    def logged(texts, lang):
        with open(log, "a", encoding="utf-8") as f:
            f.write(lang)
        return [f"[{lang}] {t}" for t in texts]

    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i}") for i in range(700)], "id long, text string").coalesce(1)
    got = aug.translate_wide(df, "text", ["x", "y"], logged, chunk=8).collect()
    assert [(r["text"] and f"[x] {r['text']}", r["text"] and f"[y] {r['text']}") for r in got] == [(r["augmented_x"], r["augmented_y"]) for r in got]
    with open(log, encoding="utf-8") as f:
        assert "yx" in f.read()


def test_a_memory_names_what_it_lacks_without_texts(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    memory = f"{tmp_dir}/m"
    assert tm.fill_memory(df.filter("id = 1"), "text", ["x"], lambda t, lang: t, memory) == 1
    left = tm.missing(df, "text", ["x", "y"], memory)
    assert left.columns == ["key", "langs"] and sorted(tuple(r["langs"]) for r in left.collect()) == [("x", "y"), ("y",)]
    assert tm.fill_memory(df, "text", ["x", "y"], lambda t, lang: t, memory) == 3 and os.path.isdir(memory)


def test_look_ups_are_made_in_pieces(spark):
    batch = pa.RecordBatch.from_pydict({"i": list(range(600))})
    cut = list(pieces([batch, batch], PIECE_ROWS))
    assert max(p.num_rows for p in cut) == PIECE_ROWS and [i for p in cut for i in p.column("i").to_pylist()] == 2 * list(range(600))
    words = spark.createDataFrame([(f"w{i}", i) for i in range(50)], "token string, term_id int")
    docs = spark.createDataFrame([(i, f"w{i % 60} w{i % 7} other" if i % 5 else None) for i in range(900)], "id long, text string").coalesce(1)
    want = {r["id"]: r["input_ids"] for r in token_ids(docs, "id", words).collect()}
    assert {r["id"]: r["input_ids"] for r in PerfectVocabulary.build(words).token_ids(docs, "id").collect()} == want


def test_token_ids_need_no_counts_per_document(spark, monkeypatch):
    monkeypatch.delattr(SplitFeatures, "tc")
    assert qv._token_ids(spark, SF_SMALL).count() == 200
