"""State that a Python worker keeps between tasks (code pickled by value has no lasting module globals)."""

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager


def kept(slot, version, build):
    """The object of a slot in this process. Another version takes its place, so that workers never gather old ones."""
    store = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept")).__dict__
    found = store.get(slot)
    if found is None or found[0] != version:
        store.pop(slot, None)
        found = store[slot] = (version, build())
    return found[1]


def only(*slots: str) -> None:
    """Drop what other operators keep in this worker: its memory holds the tables of one operator at a time."""
    store = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept")).__dict__
    others = [k for k in store if not k.startswith("__") and k not in slots]
    for k in others:
        del store[k]
    if others:
        give_back()


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cyclic garbage inside: for code that makes many lasting objects and no cycles."""
    import gc

    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def give_back() -> None:
    """Return freed memory to the system: an idle worker should not hold what its last task needed."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
