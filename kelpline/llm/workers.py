"""Memory of Python workers. They live on between tasks, and what a task has freed stays theirs unless given back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

LARGE = 4 << 20  # bytes that a group takes and makes after which its memory is given back
OWN_PAGES = 1 << 20  # buffers from this size on have pages of their own, which go back as soon as they are freed


@functools.cache
def steady() -> None:
    """Holds the size of buffers with pages of their own: left alone, the C library raises it with each one freed."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Returns freed memory to the system, where the C library knows how."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def task(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives memory back when it ends."""

    @functools.wraps(function)
    def run(*args):
        steady()
        try:
            yield from function(*args)
        finally:
            give_back()

    return run


def group(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one group's table, or of two, that gives memory back after a large group."""

    def finished(made: pa.Table, *tables: pa.Table) -> pa.Table:
        steady()
        if sum(t.nbytes for t in (made, *tables)) > LARGE:
            give_back()
        return made

    if function.__code__.co_argcount == 1:  # Spark counts the arguments
        return functools.wraps(function)(lambda rows: finished(function(rows), rows))
    return functools.wraps(function)(lambda left, right: finished(function(left, right), left, right))
