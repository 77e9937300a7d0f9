"""Giving a Python worker's unused memory back when its task ends.

Workers outlive their tasks and serve later, unrelated stages, and both Arrow's
pool and the C allocator keep what was freed.  On executors that share a limit
between the JVM and several workers, what is kept adds up.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa


def release() -> None:
    """Return freed memory to the system, as far as the platform knows how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f):
    """A partition function that releases memory after its last batch."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run
