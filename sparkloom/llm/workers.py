"""Python workers that give memory back.

Spark keeps workers for later tasks, and what one operator's task has freed stays
with the process unless the allocators are told to return it.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable


def trim() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """``run``, a function from batches to batches, with ``trim`` after its last batch."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trimmed_group(run: Callable) -> Callable:
    """The same for a function of one group's table."""

    @functools.wraps(run)
    def whole(table):
        try:
            return run(table)
        finally:
            trim()

    return whole
