"""Objects that a Python worker keeps between tasks, wherever the functions that use them came from."""

from __future__ import annotations

import ctypes
import ctypes.util
import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_MODULE = "supportlake_worker_memory"


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``key`` in this process; functions sent by value share it too."""
    held = sys.modules.setdefault(_MODULE, types.ModuleType(_MODULE)).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Returns freed memory to the system: a worker stays for later stages, and its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    library = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(library), "malloc_trim", None) if library else None
    if trim is not None:
        trim(0)
