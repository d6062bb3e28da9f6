"""Memory of Python workers, which outlive tasks and are shared by the operators that run one after another."""

from __future__ import annotations

import ctypes
import gc

_owner = ""
_caches: list[dict] = []


def release() -> None:
    """Called when a task ends that held much: gives freed memory back to the system."""
    gc.collect()
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def claim(owner: str, cache: dict | None = None) -> None:
    """Called when a task of ``owner`` begins: if another operator ran here before, its caches are emptied and what they
    held is given back to the system. ``cache`` is emptied when the next one comes."""
    global _owner
    if _owner != owner:
        for c in _caches:
            c.clear()
        _caches.clear()
        _owner = owner
        release()
    if cache is not None and not any(c is cache for c in _caches):
        _caches.append(cache)
