"""What a Python worker keeps between tasks: the caches of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[str, Any] = {}
_user = ""


def enter(user: str) -> None:
    """Called as a task begins: caches of another operator go, and freed memory returns to the system."""
    global _user
    if not _user:
        pa.set_memory_pool(pa.system_memory_pool())  # what Arrow frees can then be returned, too
    if user != _user:
        _held.clear()
        _user = user
        gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def held(key: str, make: Callable[[], Any]) -> Any:
    """The worker's object of this key, made at first use."""
    if key not in _held:
        _held[key] = make()
    return _held[key]
