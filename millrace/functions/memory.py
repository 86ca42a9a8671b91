"""Memory of Python workers, which are used again from task to task."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass
