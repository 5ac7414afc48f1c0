"""Cutting texts into units that tokenize independently, and caches for what a unit becomes.

Texts repeat their words, so Python looks a unit up and does the costly work once a distinct unit and worker.
The caches hold a bounded number of entries and live as long as the worker process; they change speed, never a result.
"""

from __future__ import annotations

import ctypes
import re
import struct
from collections.abc import Callable, Hashable

import pyarrow as pa

#: Two neighbouring white-space characters; such texts are split by the full pattern.
_RUNS = re.compile(r"[\s\x85]{2}")


class Cache(dict):
    """A dict that makes missing values; of two generations the older goes when the younger is full."""

    def __init__(self, make: Callable, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 200:  # a unit can be a whole text without spaces
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict[Hashable, object] = {}


def once(key: Hashable, make: Callable[[], object]):
    """The worker's own copy of something costly to build. One is kept: what another operator built goes first."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what an earlier operator built in this worker, before one begins that keeps a table of its own."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system, so that idle workers leave it to others; where the C library can't, it stays."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def units(text: str) -> list[str] | None:
    """``text`` cut before each space and newline, or None if it has runs of white space.

    The first unit is the text's beginning as it is. Each further unit either begins with a newline or stands for
    itself behind one space. With no two white-space characters in a row, the usual byte-level pattern has a token
    boundary at each of these cuts and looks no further than the unit.
    """
    return None if _RUNS.search(text) else text.replace("\n", " \n").split(" ")


def spelled(unit: str) -> str:
    """The characters that a unit other than the first stands for."""
    return unit if unit[:1] == "\n" else " " + unit


def shown(match: str, table: dict[int, str]) -> str:
    """A match in the characters of byte-level vocabularies; printable ASCII but the space stands for itself."""
    if match.isascii() and match.isprintable():
        return match.replace(" ", table[32])
    return match.encode().decode("latin-1").translate(table)


def pack_ids(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_characters() -> dict[int, str]:
    """The reversible table of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    return table | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in table)}
