"""Maximal periodic runs of words in each text, from bit-parallel comparisons of the text with itself at a lag.

A text's words get ids; bit plane b is a big integer whose bit i is bit b of word i's id. A plane XORed with itself
shifted by q, ORed over the planes, marks the words that differ from the one q words on. In what is left, doubling shifts
under AND isolate stretches of at least max(least - q, q) equal words: each is a run of length stretch + q. An interval
found before by a smaller lag isn't reported again, so a run's period is its smallest.

Small lags are all compared. Of the larger ones only those that some place allows: a stretch of q or more equal words
covers a word whose number is a multiple of m = 2**(j - 1), for q from 2**j up to 2**(j + 1), and goes on for q - m words
from there. So the m words at each multiple of m are looked up, by a rolling hash, among all windows 2**j to 2**(j + 1)
words on, and a lag is kept if the q - m words agree too. Equal words have equal hashes, so no lag is lost; a lag too
many costs time alone. Lookups inside a run found before whose period is at most m are skipped: there the smaller period
divides the lag.

Edge cases: a null or empty text, or one of white space, has no words and no runs, and the digests of an empty string; a
null doc_id is a doc_id like others; every row is a row of the result, repeated ones too; an empty table gives an empty result.
Other columns play no part. A text is one task's work whatever its length: a few words of 64 bits for every word of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Lags below this are all compared.
SMALL_LAGS = 64
_BASE = 0x9E3779B97F4A7C15 | 1
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _planes(ids: np.ndarray) -> list[int]:
    """Bit planes of the ids as big integers, lowest bit first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(top, 1))]


def _ones(x: int, n: int) -> np.ndarray:
    """Places of the set bits among the first n."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def _stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the runs of period `lag`, not always their smallest, in a text of n words."""
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    same = ~differ & ((1 << (n - lag)) - 1)
    want, have, long_enough = max(least - lag, lag), 1, same
    while long_enough and have < want:
        step = min(have, want - have)
        long_enough &= long_enough >> step
        have += step
    if not long_enough:
        return []
    # Bit i is set where a stretch of `want` begins: a block of set bits is one longer stretch.
    first = _ones(long_enough & ~(long_enough << 1), n)
    last = _ones(long_enough & ~(long_enough >> 1), n)
    return [(a, b - a + want + lag) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


class _Windows:
    """Rolling hashes of windows of a sequence of ids: equal windows have equal hashes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(29)
            self.run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:n], dtype=np.uint64)])
        self.up, self.n = up, n

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.run[start + length] - self.run[start]) * self.up[self.n - start]


def _large_lags(windows: _Windows, scale: int, reach: np.ndarray) -> np.ndarray | None:
    """Lags from 2**scale up to 2**(scale + 1) that some place allows; None if no window of this size occurs twice.

    `reach`: for every word the end of the furthest run over it of a period of at most 2**(scale - 1).
    """
    n, low, m = windows.n, 1 << scale, 1 << (scale - 1)
    places = np.arange(n - m + 1)
    hashes = windows.at(places, m)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if fresh.all():
        return None
    group = np.empty(len(places), np.int64)
    group[order] = np.cumsum(fresh) - 1
    key = group[order] * (n + 1) + order  # ascending: groups in turn, places ascending in each
    anchors = places[::m]
    base = group[anchors] * (n + 1)
    lo = np.searchsorted(key, base + np.minimum(anchors + low, n))
    hi = np.searchsorted(key, base + np.minimum(anchors + 2 * low, n))
    lags: set[int] = set()
    for k in np.flatnonzero(hi > lo).tolist():
        p = int(anchors[k])
        q = order[lo[k] : hi[k]] - p
        q = q[(p + q + m > reach[p]) & (p + q + q - m <= n)]
        if len(q):
            lags.update(q[windows.at(np.full(len(q), p), q - m) == windows.at(p + q, q - m)].tolist())
    return np.array(sorted(lags), np.int64)


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least `least` words and two periods, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    planes, found = _planes(ids), {}

    def compare(lag: int) -> None:
        for run in _stretches(planes, n, lag, least):
            found.setdefault(run, lag)

    for lag in range(1, min(SMALL_LAGS, n // 2 + 1)):
        compare(lag)
    windows, scale = None, SMALL_LAGS.bit_length() - 1
    while 1 << scale <= n // 2:
        windows = windows or _Windows(ids)
        reach = np.zeros(n + 1, np.int64)
        for (start, length), lag in found.items():
            if lag <= 1 << (scale - 1):
                reach[start] = max(reach[start], start + length)
        lags = _large_lags(windows, scale, np.maximum.accumulate(reach))
        if lags is None:
            break
        for lag in lags[lags <= n // 2].tolist():
            compare(lag)
        scale += 1
    return sorted((start, length, lag) for (start, length), lag in found.items())


def planted(words: list, doc_id: int | None) -> list:
    """A rewriting that plants runs: in one document of ten, by its doc_id, the words repeat from some word on."""
    h, n = (None if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def describe(words: list[bytes], least: int = LEAST) -> tuple:
    """n_words, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of one text."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = find_runs(np.fromiter(map(code.__getitem__, words), np.int64, len(words)), least)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]
    listed = "".join(f"{s},{e},{q}\n" for s, e, q in runs)
    longest = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    best = (None,) * 4 if longest is None else (*longest, 1000 * longest[1] // longest[2])
    return len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def detect(docs: DataFrame, least: int = LEAST, rewrite: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the longest run, and digests of all runs and of the text without their repeats.

    Words lie between spaces and the control characters 9 to 13. `rewrite` takes a text's words and its doc_id and gives
    the words to read instead. One pass over the texts, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = (t.as_py() or b"").split()  # of bytes: at these six characters alone
                rows.append((i, *describe(rewrite(words, i) if rewrite else words, least)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
