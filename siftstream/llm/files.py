"""Binary files in the shared folder, from executors."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable


def opened(path: str, mode: str = "rb"):
    """A binary file by URI: local paths by Python, others by pyarrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner) if mode == "rb" else system.open_output_stream(inner)
    if mode == "wb":
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, mode)


def new_name(folder: str, stem: str, end: str) -> str:
    """A name that no other attempt of a task uses; only names in a written manifest count."""
    return f"{folder}/{stem}-{uuid.uuid4().hex[:10]}{end}"


_held: dict = {}


def held(key: Hashable, make: Callable):
    """What a worker process keeps between tasks, one thing at a time: asking for another drops the one before it, so that
    the caches of one stage do not add to the memory of the next."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives back what an earlier stage has left in this worker process."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it
