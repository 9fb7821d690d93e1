"""What a Python process does between tasks or after a large step."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError):  # no such call in this C library
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, followed by returning freed memory to the system: a worker lives on beside the next stage's, and its allocators would keep it."""

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return whole
