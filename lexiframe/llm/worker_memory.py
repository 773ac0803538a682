"""Memory of Python workers, which outlive their tasks.

A worker keeps what its C heap and Arrow's pool have freed, and the tokenizers
that an earlier step loaded, and goes on to other steps with it; next to a
large JVM these add up.  ``frugal`` work gives both back to the system.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` of ``mapInArrow`` that needs no tokenizer: those kept by earlier
    tasks of this worker go first, and what it has freed itself goes at its end."""

    def run(batches):
        tokens = sys.modules.get("lexiframe.llm.tokens")
        if tokens is not None:
            tokens.cached_tokenizer.cache_clear()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def gathered(held: list[tuple]) -> list:
    """The columns of blocks of rows as one array each; ``held`` is emptied column by column."""
    columns = [list(c) for c in zip(*held, strict=True)]
    held.clear()
    out = []
    for i in range(len(columns)):
        out.append(np.concatenate(columns[i]))
        columns[i] = None
    return out
