"""Sequence files and shards against plain Python."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiframe.llm import sequence_files as sf
from lexiframe.llm import sharding as sh
from lexiframe.llm.sequence_files import op3_sequence_files
from lexiframe.llm.sharding import op5_jump_shards
from tests.llm.helpers import clashing, documents, saved, text

ROWS = [(5, "Hello world.\n\nAgain"), (1, None), (3, ""), (9, text(1, 5000)), (2, "Hello world."), (2, "Hello world."), (None, "no id")]


def _ids(path, t, end):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return [*tok.encode(t or "", add_special_tokens=False).ids, end]


def test_digests_starts_and_random_access(spark, tmp_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = clashing(documents(spark, ROWS)).repartition(3)
    rows = op3_sequence_files(spark, saved(docs, tmp_dir)).collect()
    start, want = 0, []
    for key, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = _ids(path, t, 0)
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_sequences_and_masks_by_number(spark, tmp_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    index = sf.write_sequences(documents(spark, ROWS).coalesce(1), "doc_id", "text", path, 0, f"{tmp_dir}/seq", length=16, rows=4)
    rows = sorted(index.collect(), key=lambda r: (r.file, r.local))
    for file in {r.file for r in rows}:
        mine = [r for r in rows if r.file == file]
        ids = [i for r in mine for i in _ids(path, next(t for k, t in ROWS if k == r.id), 0)]
        reader = sf.SequenceReader(file, mine[0].head, mine[0].stride, 16, 4)
        n = -(-len(ids) // 16)
        for i in reversed(range(n)):
            got, mask = reader.sequence(i)
            real = ids[i * 16:(i + 1) * 16]
            assert list(got[: len(real)]) == real and list(mask) == [True] * len(real) + [False] * (16 - len(real))


def test_no_documents(spark, tmp_dir):
    empty = saved(documents(spark, []), tmp_dir)
    assert op3_sequence_files(spark, empty).count() == 0 and op5_jump_shards(spark, empty).count() == 0


def _jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & (2 ** 64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth():
    keys = np.arange(-5000, 15000, dtype=np.int64)
    mixed = sh.mix(keys.view(np.uint64))
    for n in (1, 2, 16, 17, 1000):
        assert sh.jump_hash(keys, n).tolist() == [_jump(int(k), n) for k in mixed]
    a, b = sh.jump_hash(keys, 16), sh.jump_hash(keys, 17)
    moved = a != b
    assert set(b[moved]) == {16} and abs(moved.mean() - 1 / 17) < 0.01
    assert np.bincount(a).min() > 0.85 * len(keys) / 16
    with pytest.raises(ValueError):
        sh.jump_hash(keys, 0)


def test_shards_of_documents(spark, tmp_dir):
    rows = [*ROWS, *[(i, f"t{i}") for i in range(100, 400)]]
    got = op5_jump_shards(spark, saved(clashing(documents(spark, rows)).repartition(5), tmp_dir)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    for r in got:
        texts = {t or "" for k, t in rows if k == r.doc_id}
        assert (r["size"], r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts}
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert len({r.shard for r in got if r.doc_id == 2}) == 1


def test_written_shards(spark, tmp_dir):
    sh.write_shards(documents(spark, [(i, f"t{i}") for i in range(50)]), "doc_id", 4, f"{tmp_dir}/shards", max_rows_per_file=5)
    back = spark.read.parquet(f"{tmp_dir}/shards")
    keys = np.array([r.doc_id for r in back.collect()], dtype=np.int64)
    want = dict(zip(keys.tolist(), sh.jump_hash(keys, 4).tolist()))
    assert {r.doc_id: r.shard for r in back.collect()} == want
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 5
