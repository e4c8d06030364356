"""Word shingles of whole texts as 64-bit hashes, from numpy over blocks of bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z are lower-cased
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n of the base or its inverse modulo 2**64, kept for the next block."""
    if kind not in _powers or len(_powers[kind]) <= n:
        step = np.uint64(_BASE if kind == "up" else _INVERSE)
        with np.errstate(over="ignore"):
            _powers[kind] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, step, np.uint64))])
    return _powers[kind][: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a block's texts, and the index of each text's first word (and the end)."""
    n = len(body)
    inside = ~_BLANK[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]])[:n] | edge[:n]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]])[:n] | edge[1:])) + 1
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[body] * _power("up", n)[:n], dtype=np.uint64)])
        words = mixed((run[ends] - run[begins]) * _power("down", n)[begins] + (ends - begins).astype(np.uint64) * _PLACE[63])
    return words, np.searchsorted(begins, offsets)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted. A text with fewer words has them all as one; one without words has none."""
    hashes, first = word_hashes(body, offsets)
    with np.errstate(over="ignore"):
        n = max(len(hashes) - words + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += hashes[k : k + n] * _PLACE[k]
        rolled = mixed(rolled)
        sets = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= words:
                sets.append(np.unique(rolled[lo : hi - words + 1]))
            elif hi > lo:
                total = (hashes[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo) * _PLACE[62]
                sets.append(mixed(np.array([total], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets
