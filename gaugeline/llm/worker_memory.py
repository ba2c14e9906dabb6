"""What a Python worker remembers between tasks: for one operator at a time.

Workers live longer than stages.  A worker that turns to another operator forgets what it
remembered for the one before, so memories of several operators never add up, and gives the
freed memory back to the machine.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable

import pyarrow as pa

_holder: list[tuple[str, Callable[[], None]]] = []


def give_back() -> None:
    """Freed memory that Arrow and the C library still hold goes back to the machine."""
    pa.default_memory_pool().release_unused()
    library = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(library), "malloc_trim", None) if library else None
    if trim is not None:
        trim(0)


def remember_for(operator: str, forget: Callable[[], None]) -> None:
    """To be called when a task of ``operator`` starts; ``forget`` empties its memory."""
    if _holder and _holder[0][0] == operator:
        return
    for _, drop in _holder:
        drop()
    give_back()
    _holder[:] = [(operator, forget)]
