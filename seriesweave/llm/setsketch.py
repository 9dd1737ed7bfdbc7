"""SetSketch registers of word shingles, and what is told from them, in numpy.

Every shingle draws, for each of the registers once and in its own order, a growing series
of exponentially distributed numbers. A register keeps the smallest it gets, rounded on an
exponential scale of base BASE. Registers of a union are the larger of two registers each;
two sets share a register about as often as they share elements.
"""

from __future__ import annotations

import numpy as np

from seriesweave.llm.words import Words, batches, mix, words

BANDS, ROWS = 32, 5  # at a similarity of 0.8 all bands miss with a chance of 3e-6
RUN = 200_000  # characters sketched at once; a longer text is a run of its own
REGISTERS = 163  # a prime, so that every step walks through all of them; bands use 160
BASE = 1.02
_STEP = 0x9E3779B97F4A7C15
_ODD = np.uint64(_STEP)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of `size` words, sorted, and where each text's begin.

    A text with fewer words, but any, has its whole sequence as its only shingle.
    """
    h = w.hashes(w.starts, w.ends)
    counts = np.diff(w.first)
    n = len(h)
    rolled = np.zeros(n, dtype=np.uint64)
    if n >= size:
        part = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            part = mix(part * _ODD + h[j : n - size + 1 + j])
        rolled[: n - size + 1] = part
    within = np.arange(n) - np.repeat(w.first[:-1], counts)
    whole = within + size <= np.repeat(counts, counts)
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        value = np.full(1, counts[i], dtype=np.uint64)
        for j in range(w.first[i], w.first[i + 1]):
            value = mix(value * _ODD + h[j : j + 1])
        rolled[w.first[i]], whole[w.first[i]] = value[0], True
    text = np.repeat(np.arange(len(counts)), counts)[whole]
    rolled = rolled[whole]
    ends = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        rolled[a:b].sort()
    new = np.ones(len(rolled), dtype=bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (text[1:] != text[:-1])
    return rolled[new], np.concatenate([[0], np.cumsum(new)])[ends]


def shingle_sets(texts: list[str | None], size: int):
    """(first text, hashes, starts) for runs of texts."""
    for a, b in batches(texts, RUN):
        yield a, *shingles(words(texts[a:b]), size)


def digests(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, alike for equal sets."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (0x51, 0xA7)]
    return tuple(mix(s[ends[1:]] - s[ends[:-1]]) for s in sums)


def registers(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of registers for each set; empty sets have zeros."""
    sets, m = len(ends) - 1, REGISTERS
    least = np.full((sets, m), np.inf)
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(ends))
    element, at = hashes, (mix(hashes ^ np.uint64(0x3C)) % np.uint64(m)).astype(np.int64)
    step = (mix(hashes ^ np.uint64(0xC3)) % np.uint64(m - 1)).astype(np.int64) + 1
    value = np.zeros(len(hashes))
    for j in range(m):
        draw = mix(element + np.uint64((j + 1) * _STEP % 2**64))
        value = value - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m - j)
        np.minimum.at(flat, owner * m + at, value)
        alive = value < least.max(axis=1)[owner] if j < 4 else _below(value, least, owner)
        owner, element, step, value = owner[alive], element[alive], step[alive], value[alive]
        at = (at[alive] + step) % m
        if not len(owner):
            break
    out = np.zeros((sets, m), dtype=np.uint16)
    some = np.diff(ends) > 0
    scaled = np.floor(1 - np.log(least[some]) / np.log(BASE)) + 400
    out[some] = np.clip(scaled, 1, 65535).astype(np.uint16)
    return out


def _below(value: np.ndarray, least: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an element may still lower a register of its set."""
    sets, at = np.unique(owner, return_inverse=True)
    return value < least[sets].max(axis=1)[at]


def bands(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of registers, for each row of registers."""
    parts = rows[:, : BANDS * ROWS].astype(np.uint64).reshape(len(rows), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(rows), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * _ODD + parts[:, :, j])
    return key


_GRID = np.linspace(0.005, 0.995, 199)


def _chance(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set is larger, by the share of elements that only it has."""
    x = np.clip(x, 1e-9, 1 - 1e-9)
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most likelihood, given how many registers are larger, smaller and equal.

    a and b are rows of registers, n_a and n_b the numbers of elements.
    """
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    up, down = _chance(u - v * _GRID), _chance(v - u * _GRID)
    same = np.clip(1 - up - down, 1e-9, 1)
    value = more * np.log(up) + less * np.log(down) + equal * np.log(same)
    value[_GRID > np.minimum(u / v, v / u) + 0.01] = -np.inf
    return _GRID[value.argmax(axis=1)]
