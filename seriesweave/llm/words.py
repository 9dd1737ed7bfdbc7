"""Words of many texts at once, with a 64-bit hash each, in numpy.

A word is a run of bytes that are no ASCII white space (`[^\\x20\\x09-\\x0D]+`).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Anything but a-z and bytes of non-ASCII characters, for words of letters only.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = False
NO_LETTER[128:] = False
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    forward = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n, _INVERSE, dtype=np.uint64)
    forward[0] = back[0] = 1
    return np.cumprod(forward, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


@dataclass
class Words:
    data: bytes  # all texts, one after another
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]
    sums: np.ndarray  # prefix sums behind `hashes`

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of data; equal bytes have equal hashes."""
        _, back = _powers(_size(len(self.sums)))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _size(n: int) -> int:
    return 1 << max(16, int(n - 1).bit_length())


def words(texts: list[str | None], lower: bool = True, between: np.ndarray = _SPACE) -> Words:
    """The words of each text; a null text has none. `lower` turns A-Z into a-z, `between` marks the bytes between words."""
    parts = [text.encode() if text else b"" for text in texts]
    data = b" ".join(parts) + b" "
    if lower:
        data = data.translate(LOWER)
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    buffer = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(between[buffer], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    forward, _ = _powers(_size(len(data) + 1))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buffer] * forward[: len(data)], out=sums[1:])
    return Words(data, starts, ends, np.searchsorted(starts, at), sums)


def batches(texts: list[str | None], most: int = 500_000):
    """Split a list of texts into runs (start, stop) of about `most` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Memory that this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over batches, where the worker gives the memory it needs no more back to the machine after each batch and at the end.

    Workers are used again by later tasks and otherwise keep what all their batches left in pieces.
    """

    def each(tables: Iterator) -> Iterator:
        for table in tables:
            yield table
            del table
            give_back()

    @functools.wraps(run)
    def over(tables: Iterator) -> Iterator:
        try:
            yield from run(each(tables))
        finally:
            _powers.cache_clear()
            give_back()

    return over
