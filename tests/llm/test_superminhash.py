"""SuperMinHash signatures against one permutation at a time, and groups against all pairs."""

import re

import numpy as np
import pytest
from edge_rows import documents
from oracle import normal, run_sql

from fieldweave.llm import superminhash
from fieldweave.llm.queries import ORACLE_SQL, QUERIES
from fieldweave.llm.shingles import mixed


def one_by_one(items, registers):
    """Every item deals its permutation to the end."""
    held = [2**64 - 1] * registers
    for item in items:
        order = list(range(registers))
        for rank in range(registers):
            x = int(mixed(np.array([(int(item) + (rank + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            pick = rank + (((x >> 32) * (registers - rank)) >> 32)
            order[rank], order[pick] = order[pick], order[rank]
            held[order[rank]] = min(held[order[rank]], rank << 32 | x & 0xFFFFFFFF)
    return held


def test_signatures_stop_early_without_a_change():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 3, 10, 40, 200, 0, 1000)]
    got = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 32)
    assert [one_by_one(s, 32) for s in sets] == got.tolist()


def test_lower_variance():
    """The share of equal registers estimates the similarity, with less spread than of independent hash functions."""
    rng, registers, shares = np.random.default_rng(1), 130, []
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        b = np.concatenate([a[16:], rng.integers(0, 1 << 63, 16).astype(np.uint64)])
        x, y = superminhash.signatures(np.concatenate([a, b]), np.array([200, 200]), registers)
        shares.append((x == y).mean())
    s = 184 / 216
    assert abs(np.mean(shares) - s) < 0.01 and np.std(shares) < 0.9 * (s * (1 - s) / registers) ** 0.5


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


@pytest.mark.parametrize("seed", range(2))
def test_all_pairs(spark, seed):
    """Chains of edited copies, groups of copies with many edits, repeats of texts and of doc_ids."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocabulary, rng.integers(8, 120)))
        for _ in range(rng.integers(1, 14)):
            texts.append(" ".join(base))
            if rng.random() < 0.7:
                base[rng.integers(len(base))] = "edited" + str(rng.integers(1000))
            if rng.random() < 0.3:
                base.insert(rng.integers(len(base)), "Added")
    texts += texts[::9] + ["", None, " \t", "one", "One two", "one TWO", "the same three", "The same three words"]
    order = rng.permutation(len(texts))
    rows = [(int(k), texts[k]) for k in order]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in rows}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_edge_rows(spark):
    rows = superminhash.near_duplicates(documents(spark)).collect()
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 13 and got[None, 2] == (None, True) and got[2, 5] == (1, False) and got[9, 1] == (8, False) and got[4, 0] == (4, True)
    assert superminhash.near_duplicates(documents(spark, True)).count() == 0


def test_query(spark, data):
    got = [r.asDict() for r in QUERIES["op12_superminhash"](spark, data).collect()]
    assert normal(got) == normal(run_sql(ORACLE_SQL["op12_superminhash"], data))
