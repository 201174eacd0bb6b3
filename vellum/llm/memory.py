"""One operator's memo at a time in a Python worker.

Workers are reused from stage to stage; without this, each stage's memo would
stay beside the next one's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None]) -> None:
    """``name`` is going to fill its memo: all others are released."""
    others = [k for k in _HELD if k != name]
    for other in others:
        _HELD.pop(other)()
    if others or not _HELD:
        _give_back()
    _HELD[name] = release


def _give_back() -> None:
    """What was freed, back to the system: allocators keep it for a worker that goes on to other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
