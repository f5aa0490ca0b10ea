"""What a Python worker keeps between tasks, and when it gives it back.

A worker serves the tasks of many stages, one after another, and then lies idle while
others serve. Caches of one operator at a time live in it: they go when a kernel of
another operator starts, or when no task has used them for `IDLE` seconds, and freed
memory returns to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

IDLE = 1.0
_lock = threading.RLock()
_held: list[tuple[object, Callable[[], object]]] = []
_state = {"users": 0, "turn": 0}


def trim() -> None:
    """Hand free memory of the C library back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _drop() -> None:
    if _held:
        _held.pop()[1]()
        gc.collect()


def enter(key: object, drop: Callable[[], object] | None) -> None:
    """A task begins that uses the caches named `key` (None: it has none). Arrow then
    takes its memory from the C library, as its own pool gives it back by thread."""
    with _lock:
        pa.set_memory_pool(pa.system_memory_pool())
        if _held and _held[0][0] != key:
            _drop()
            trim()
        if drop is not None and not _held:
            _held.append((key, drop))
        _state["users"] += 1
        _state["turn"] += 1


def _idle(turn: int) -> None:
    with _lock:
        if _state["users"] == 0 and _state["turn"] == turn:
            _drop()
            trim()


def leave() -> None:
    """The task ends; its caches stay for the next one, for a while."""
    with _lock:
        _state["users"] -= 1
        if not _state["users"]:
            timer = threading.Timer(IDLE, _idle, (_state["turn"],))
            timer.daemon = True
            timer.start()


def kernel(run: Callable[[Iterable], Iterator], key: object = None, drop: Callable[[], object] | None = None) -> Callable[[Iterable], Iterator]:
    """`run` for mapInArrow; `drop` empties the caches it keeps under `key`, if any."""

    def guarded(batches):
        enter(key, drop)
        try:
            yield from run(batches)
        finally:
            leave()

    return guarded
