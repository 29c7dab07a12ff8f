"""Memory that Python workers hold between tasks: large arrays go back to the system when they are freed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Options of the C library's mallopt, and the least size of an allocation of its own.
MMAP_THRESHOLD, TRIM_THRESHOLD = -3, -1
OWN = 4 << 20


def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "mallopt") and hasattr(found, "malloc_trim") else None
    except OSError:  # another C library
        return None


def released() -> None:
    """Gives back what the worker no longer uses."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.mallopt(MMAP_THRESHOLD, OWN)
        libc.mallopt(TRIM_THRESHOLD, OWN)
        libc.malloc_trim(0)


def streamed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, with memory given back before and after."""

    def lean(batches: Iterator) -> Iterator:
        released()
        yield from run(batches)
        released()

    return lean


def grouped(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def lean(table: pa.Table) -> pa.Table:
        out = run(table)
        released()
        return out

    return lean


def cogrouped(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def lean(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        released()
        return out

    return lean
