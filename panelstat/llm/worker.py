"""Python workers outlive their tasks and operators; what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa


def release() -> None:
    """Hands freed memory of Python, Arrow and the C library back, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """A map over batches that releases memory at its task's end, after `forget` has emptied what it kept."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            release()

    return mapped
