"""Periodic runs against a comparison of every word at every lag, and their registered query."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from edge_rows import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldweave.llm import periodic_runs
from fieldweave.llm.queries import QUERIES
from fieldweave.tables import table


def by_hand(words, least=12):
    """Runs found by walking over the words at every lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - begin + q >= max(least, 2 * q):
                found.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_hand(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, n, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def shapes(rng):
    yield rng.integers(0, rng.integers(1, 4), rng.integers(0, 400))
    period = rng.integers(0, 3, rng.integers(1, 250))
    yield np.concatenate([rng.integers(0, 5, rng.integers(0, 60)), np.tile(period, 3)[: rng.integers(1, 3 * len(period) + 1)], rng.integers(0, 5, rng.integers(0, 60))])
    yield np.concatenate([np.repeat(rng.integers(0, 3), rng.integers(1, 120)) for _ in range(6)])
    block = np.concatenate([np.zeros(rng.integers(20, 150), int), np.ones(rng.integers(1, 30), int)])
    yield np.concatenate([np.tile(block, rng.integers(1, 4)), rng.integers(0, 2, 40)])
    long = np.tile(rng.integers(0, 1000, rng.integers(60, 260)), 4)
    long[rng.integers(0, len(long), rng.integers(0, 4))] = 7777
    yield long
    a, b = [0], [0, 1]
    for _ in range(rng.integers(3, 12)):
        a, b = b, b + a
    yield np.array(b)


@pytest.mark.parametrize("seed", range(40))
def test_every_lag(seed):
    for ids in shapes(np.random.default_rng(seed)):
        assert periodic_runs.find_runs(ids.astype(np.int64)) == by_hand(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5), st.integers(1, 4))
def test_repeated_parts(parts, times):
    ids = [x for part in parts for x in part * times]
    assert periodic_runs.find_runs(np.array(ids, np.int64)) == by_hand(ids)


def test_few_large_lags():
    """One word 200,000 times over, and words without repeats, are no quadratic work."""
    assert periodic_runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.find_runs(np.arange(200_000)) == []
    assert periodic_runs.find_runs(np.tile(np.arange(30_000), 5)) == [(0, 150_000, 30_000)]


def test_query(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, data).collect()}
    short = [r for r in docs if len(r["text"] or "") < 9000]
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])
    assert sum(r[2] > 0 for r in got.values()) > 0.05 * len(docs)


def test_edge_rows(spark):
    got = sorted((tuple(r) for r in periodic_runs.detect(documents(spark), rewrite=periodic_runs.planted).where("doc_id is null or doc_id <> 6").collect()), key=repr)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in documents(spark).collect() if r["doc_id"] != 6), key=repr)
    long = periodic_runs.detect(documents(spark).where("doc_id = 6")).first()
    assert tuple(long)[1:7] == (25_000, 1, 0, 25_000, 5, 5_000_000)
    assert periodic_runs.detect(documents(spark, True)).count() == 0
