"""Hashes of the words of a whole Arrow batch of texts at once, in numpy.

Word hashes come from running sums of ``byte * base**position`` (mod 2**64),
so that the hash of any stretch is one subtraction and one multiplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import ship

ship(__name__)

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def running_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums (length n + 1) of ``values[i] * base**i``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary Arrow column's bytes and its row offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges ``(first, last)`` of at most ``limit`` bytes, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def byte_classes(groups: list[bytes]) -> np.ndarray:
    """A class for each byte: 0 for white space, else 1 + the group that
    lists it, else one more. A word is a run of one class."""
    out = np.full(256, len(groups) + 1, dtype=np.uint8)
    for i, group in enumerate(groups):
        out[np.frombuffer(group, dtype=np.uint8)] = i + 1
    out[np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)] = 0
    return out


def ascii_lower() -> np.ndarray:
    """Byte values plus one, A-Z lower-cased."""
    out = np.arange(1, 257, dtype=np.uint64)
    out[65:91] += 32
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray,
                values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts between ``offsets`` (which start at
    0), in order, and the texts' offsets into them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    full = kind[cuts[:-1]] != 0
    start, end = cuts[:-1][full], cuts[1:][full]
    sums = running_sums(values[data])
    hashes = mix((sums[end] - sums[start]) * powers(n)[1][start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)
