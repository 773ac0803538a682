"""What Python workers hold between tasks, and the size of the batches they get."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexiframe.llm import compact_windows, jaccard_groups, tokens, worker_memory
from lexiframe.llm.storage import BATCH_BYTES, written

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class _Frame:
    """Keeps what is given to ``mapInArrow``."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):  # noqa: N802
        return work


def test_kept_tokenizers_go_when_other_work_begins():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    first = tokens.cached_tokenizer(path, False)
    assert tokens.cached_tokenizer(path, False) is first
    assert list(worker_memory.frugal(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert tokens.cached_tokenizer.cache_info().currsize == 0


def test_blocks_are_emptied_as_they_are_joined():
    held = [(np.array([1, 2]), np.array([5, 6])), (np.array([3]), np.array([7]))]
    key, value = worker_memory.gathered(held)
    assert key.tolist() == [1, 2, 3] and value.tolist() == [5, 6, 7] and held == []


def test_memory_is_given_back_after_windows():
    """The heap after a task is near what it was before it, as a worker goes on to other steps."""
    def now():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon:")) // 1024

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 50_000, 400))) for _ in range(4_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], names=["id", "text"])
    del texts
    work = compact_windows.window_rows(_Frame())
    worker_memory.give_back()
    before, rows = now(), 0
    for out in work(iter([batch])):
        rows += out.num_rows
    del out
    assert rows > 100_000 and now() - before < 25


def test_ties_go_to_spark_in_small_batches():
    n = 60_000
    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2), pa.int32()), pa.array(np.arange(2 * n)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 9)), keys], names=["node", "n", "keys"])
    out = list(jaccard_groups.tied_tokens(_Frame())(iter([batch])))
    assert sum(b.num_rows for b in out) == 2 * n and max(b.num_rows for b in out) <= jaccard_groups.SLICE


def test_written_tables_use_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 3_000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 10000) as t")
    before = spark.conf.get(BATCH, None)
    got = [r["n"] for r in written(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) > 30_000_000 and max(got) < 2 * BATCH_BYTES
    assert spark.conf.get(BATCH, None) == before
    spark.conf.set(BATCH, "1m")
    try:
        got = [r["n"] for r in written(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
        assert max(got) < 2 << 20 and spark.conf.get(BATCH, None) == "1m"
    finally:
        spark.conf.unset(BATCH)
