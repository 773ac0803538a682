"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def frugal(work):
    """``work`` of ``mapInArrow`` whose worker gives freed memory back to the system at its end, where the C library can."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
