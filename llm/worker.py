"""What a Python worker keeps between tasks.

Spark reuses worker processes for all stages of a session, so what one operator keeps would still take memory
while later ones run. A worker therefore keeps one tool at a time, and hands freed memory back after its work.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_TOOL: dict[tuple, Any] = {}


def kept_tool(key: tuple, make: Callable[[], Any]) -> Any:
    """The tool of this key, from an earlier task if that was the last to ask for one."""
    if key not in _TOOL:
        drop_tool()
        _TOOL[key] = make()
    return _TOOL[key]


def drop_tool() -> None:
    """Forgets the tool that an earlier operator's task kept."""
    if _TOOL:
        _TOOL.clear()
        give_back()


def give_back() -> None:
    """Returns memory that Arrow's pool and the C library hold unused (the latter where it can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
