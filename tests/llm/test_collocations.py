"""Collocations against counts of every phrase of every piece, and their registered query."""

import re
from collections import Counter

import numpy as np
import pytest
from edge_rows import documents
from oracle import normal, run_sql

from fieldweave.llm import collocations
from fieldweave.llm.queries import ORACLE_SQL, QUERIES


def by_hand(rows, least, top, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    known = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, words), a in known.items():
        parts = lambda w: {w[i : i + len(words)] for i in range(len(w) - len(words) + 1)}  # noqa: E731, B023
        if any(x == lang and len(w) > len(words) and words in parts(w) and 100 * b >= 80 * a for (x, w), b in known.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("seed", range(3))
def test_every_phrase(spark, seed):
    """Few words, repeated words, all marks, several blocks, ties, groups that share words."""
    rng = np.random.default_rng(seed)
    words, marks = ["a", "B", "b", "c", "é", "日本", "\x00", "\x1c"], [" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\r\n", "\x0b", "!?"]
    rows = [(lang, "".join(str(rng.choice(words)) + str(rng.choice(marks)) for _ in range(rng.integers(0, 60)))) for lang in ["en", "de", None] for _ in range(40)]
    rows += rows[:10] + [("en", None), (None, ""), ("fr", "a b"), ("es", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((5, 2000), (12, 7)):
        got = {tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()}
        assert got == by_hand(rows, least, top)


def test_one_word_over_and_over(spark):
    rows = [("en", "x " * 5000), ("en", "x. " * 100)]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got == by_hand(rows, 30, 2000) and len(got) == 1


def test_edge_rows(spark):
    rows = [(r["lang"], r["text"]) for r in documents(spark).collect()]
    assert {tuple(r) for r in collocations.collocations(documents(spark)).collect()} == by_hand(rows, 30, 2000)
    assert collocations.collocations(documents(spark, True)).count() == 0


def test_query(spark, data):
    got = [r.asDict() for r in QUERIES["op11_collocations"](spark, data).collect()]
    assert normal(got) == normal(run_sql(ORACLE_SQL["op11_collocations"], data))


@pytest.mark.parametrize("offset", [0, 1 << 40])
def test_lists_are_counted_in_parts(spark, offset):
    """Ids that fit one number as a pair and those that don't; each block is told its frequent lists in the order sent."""
    rng = np.random.default_rng(offset % 7)
    sent, f = {}, Counter()
    for block in range(4):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 6, (20, 2))})
        sent[block] = [(a + offset, b + offset, int(n)) for (a, b), n in zip(pairs, rng.integers(1, 300, len(pairs)), strict=True)]
        for a, b, n in sent[block]:
            f[a, b] += n
    rows = [(block, 3, *[bytearray(collocations.planes(np.array(x))) for x in ([a for a, _, _ in lists], [1] * len(lists), [b for _, b, _ in lists], [n for _, _, n in lists])]) for block, lists in sent.items()]
    df = spark.createDataFrame(rows, "block long, part int, heads binary, sizes binary, tails binary, counts binary")
    got = collocations._counted(df, 300).collect()
    found = {(r["left"], r["right"]): (r["f"], r["rank"]) for r in got if r["f"] is not None}
    assert {p: n for p, (n, _) in found.items()} == {p: n for p, n in f.items() if n >= 300}
    assert sorted(rank for _, rank in found.values()) == list(range(len(found)))
    for r in (r for r in got if r["block"] is not None):
        hit = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=len(sent[r["block"]]))
        told = [p[:2] for p, h in zip(sent[r["block"]], hit, strict=True) if h]
        assert told == [p[:2] for p in sent[r["block"]] if p[:2] in found]
        assert collocations.numbers(r["ranks"]).tolist() == [found[p][1] for p in told]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 0], [1 << 40, 3]])
def test_planes(values):
    assert collocations.numbers(collocations.planes(np.array(values, np.int64))).tolist() == values
