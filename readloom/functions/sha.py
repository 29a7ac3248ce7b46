"""SHA-256 whose state can be taken out, so that tasks one after the other hash one stream."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from functools import lru_cache

import pyarrow as pa

#: Bytes of the library's context: eight words of state, two of length, a block of sixteen, two counters.
STATE = 4 * (8 + 2 + 16 + 2)


class Sha256:
    """A hasher that goes on from ``state`` if given; only where ``library()`` is there."""

    def __init__(self, state: bytes | None = None):
        self._context = ctypes.create_string_buffer(state, 2 * STATE) if state else ctypes.create_string_buffer(2 * STATE)
        if state is None:
            library().SHA256_Init(self._context)

    def update(self, data) -> None:
        data = pa.py_buffer(data)
        library().SHA256_Update(self._context, data.address, data.size)

    def state(self) -> bytes:
        return self._context.raw[:STATE]

    def hexdigest(self) -> str:
        out, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._context.raw, 2 * STATE)
        library().SHA256_Final(out, copy)
        return out.raw.hex()


@lru_cache(1)
def library() -> ctypes.CDLL | None:
    """The library that Python's own hashes use, or the system's; None where neither has these functions or they don't agree with ``hashlib``."""
    for find in (lambda: __import__("_hashlib").__file__, lambda: ctypes.util.find_library("crypto")):
        try:
            found = ctypes.CDLL(find() or "")
            found.SHA256_Init.argtypes = [ctypes.c_void_p]
            found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
            found.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
        except (AttributeError, ImportError, OSError):
            continue
        if _agrees(found):
            return found
    return None


def _agrees(found: ctypes.CDLL) -> bool:
    context, out, data = ctypes.create_string_buffer(2 * STATE), ctypes.create_string_buffer(32), bytes(range(256)) * 3
    found.SHA256_Init(context)
    for at in range(0, len(data), 101):
        found.SHA256_Update(context, data[at : at + 101], len(data[at : at + 101]))
        context = ctypes.create_string_buffer(context.raw[:STATE], 2 * STATE)
    found.SHA256_Final(out, context)
    return out.raw == hashlib.sha256(data).digest()
