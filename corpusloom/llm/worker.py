"""Memory of reused Python workers.

A worker lives on from task to task, also when the next task belongs to another
operator. What an operator keeps between its own tasks (vocabularies, models) is
dropped as soon as a task of another one starts, and after each task freed
memory goes back to the machine.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What the operators keep, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """The memory of an operator in this worker."""
    return _KEPT.setdefault(operator, {})


def give_back() -> None:
    """Return freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # not glibc
        pass


def task(operator: str) -> Callable:
    """Marks a function from batches to batches as a task of an operator."""

    def mark(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(run)
        def claimed(batches: Iterator) -> Iterator:
            others = [k for k in _KEPT if k != operator and _KEPT[k]]
            for k in others:
                _KEPT[k].clear()
            if others:
                gc.collect()
                give_back()
            yield from run(batches)
            give_back()

        return claimed

    return mark
