"""What a Python worker keeps from one task to the next: one operator's tables at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """The worker's object of ``key``, made where it is missing. Those of other keys go first, so a worker that serves several stages never holds two operators' tables."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what earlier tasks kept; for tasks that keep nothing themselves but need memory."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)  # else what is freed stays with the process
    except (OSError, AttributeError):
        return  # another C library: nothing to trim
