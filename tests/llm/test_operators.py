"""The operators against brute force, round trips and held-out labels on the small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import normal, run_sql
from pyspark.sql import functions as F

from fieldweave.llm import chat, jaccard, language, license_scan, line_crf, mixing, pieces, quality_rules, topk
from fieldweave.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    got = [r.asDict() for r in QUERIES[name](spark, data).collect()]
    assert normal(got) == normal(run_sql(ORACLE_SQL[name], data))


def test_licences_of_known_lines(spark):
    lines = {1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "the weather is fine and nobody has a licence to complain", 6: None}
    filler = [(k, "plain words of a text that says nothing about rights\nand a second line of it", "x") for k in range(100, 160)]
    table = spark.createDataFrame([(k, f"some text before\n{v}\nand after" if v else v, "x") for k, v in lines.items()] + filler, "doc_id long, text string, words string")
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(table).collect()}
    assert [got[k] for k in range(1, 7)] == ["apache", "mit", "gpl", "cc-by-nc", "none", "none"]
    assert {got[k] for k in range(100, 160)} == {"none"}


def test_wrapped_and_buried_notices(spark):
    """Every template, as a line, wrapped over lines and inside a long line of prose; and notices of no family."""
    rng = np.random.default_rng(2)
    words = ["weather", "river", "house", "paper", "people", "walk", "slowly", "along", "green", "fields", "and", "the", "of", "a"]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows, want = [], {}
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            assert len(text.split()) <= license_scan.WINDOW - license_scan.STRIDE
            parts = text.split()
            wrapped = "\n".join(" ".join(parts[k : k + 7]) for k in range(0, len(parts), 7))
            for form in (text, f"{prose(40)}\n\n{wrapped}\n \n{prose(30)}", f"{prose(900)} {text} {prose(700)}", f"{prose(11)} {text}"):
                want[len(rows)] = family
                rows.append((len(rows), form))
    for k in range(300):
        rows.append((len(rows), f"{prose(60)}\n\n{prose(20)} permission to walk or a license to fish {prose(int(rng.integers(0, 90)))}" if k % 3 == 0 else prose(80)))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [rows[k][1][:60] for k, family in want.items() if got[k]["licence"] != family]
    assert len(missed) <= 0.02 * len(want), missed
    assert all(got[k]["n_licensed"] == 0 for k in got if k not in want)
    assert sum(got[k]["licence"] != "none" for k in got if k not in want) <= 3


def test_gate_loses_no_confirmed_notice(spark):
    """The bigrams of a template without a word of the gate are fewer than a confirmation takes."""
    pairs = license_scan.templates(spark).select("family", F.explode(F.array_distinct("pairs")).alias("pair"), F.size(F.array_distinct("pairs")).alias("n"), F.xxhash64("words").alias("t"))
    outside = pairs.where(~F.col("pair").rlike(license_scan.GATE)).groupBy("t").agg((F.count("*") / F.first("n")).alias("share")).collect()
    assert all(r["share"] < license_scan.CONFIRM for r in outside) and len(license_scan.gate_words()) < 40


def test_reworded_notices(spark):
    """Wordings that training has not seen: a word in ten left out or replaced, within prose of other words than the sample's."""
    rng, rows, want = np.random.default_rng(5), [], {}
    prose = lambda n: " ".join(f"{a}{b}" for a, b in rng.choice(["lor", "em", "ip", "sum", "dol", "or", "sit"], (n, 2)))
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            words = text.split()
            if len(words) < 10:
                continue
            for _ in range(4):
                kept = [("such" if rng.random() < 0.5 else "") if rng.random() < 0.1 else w for w in words]
                want[len(rows)] = family
                rows.append((len(rows), f"{prose(int(rng.integers(0, 90)))} {' '.join(w for w in kept if w)} {prose(int(rng.integers(0, 90)))}"))
    rows += [(len(rows) + k, prose(150)) for k in range(300)]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[k] == family for k, family in want.items())
    assert found >= 0.85 * len(want), (found, len(want))
    assert sum(v not in ("none", "unknown") for k, v in got.items() if k not in want) == 0



def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)).astype("float32")
    x[50:80] = x[50]  # ties
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(400)] + [(1000, None, 0), (1020, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (1040, [float("nan")] * 6, 0), (1060, [float("inf")] * 6, 0), (2000, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 20 == 0, shard_rows=90, query_rows=7, pivots=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(64 * x.astype("float64"))
    assert set(got) == set(range(0, 400, 20))
    for i in got:
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:20]
        assert got[i] == [(k + 1, j, int(s[j])) for k, j in enumerate(best)]


def test_quality_rules_equal_brute_force(spark, data, docs):
    got = {r["doc_id"]: r for r in quality_rules.score_documents(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = WORD.findall(text)
        seen = defaultdict(list)
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])].append(k)
        inside = {p + d for v in seen.values() if len(v) > 1 for p in v for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def test_quality_score_equals_brute_force(spark):
    """The mean log ratio over all unigrams and bigrams, and the verdict at a threshold between two documents."""
    good, poor = " ".join(f"good{k % 60}" for k in range(70)), " ".join(f"poor{k}" for k in range(70))
    docs = spark.createDataFrame([(1, good), (2, poor), (3, None), (4, good + " " + poor)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    ratios = quality_rules.log_ratios(docs, quality_rules.trusted_sample(marks), 256)
    words = sorted(set(f"{good} {poor}".split()))
    h = dict(zip(words, spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).toPandas().iloc[:, 1].tolist(), strict=True))
    pairs = sorted({(x, y) for t in (good, poor, good + " " + poor) for x, y in zip(t.split(), t.split()[1:])})  # noqa: B905
    twos = {(r[0], r[1]): r[2] for r in spark.createDataFrame([(x, y, h[x], h[y]) for x, y in pairs], "x string, y string, a long, b long").select("x", "y", F.xxhash64("a", "b")).collect()}
    want = {}
    for doc_id, text in ((1, good), (2, poor), (4, good + " " + poor)):
        w = text.split()
        grams = [ratios[h[x] % 256] for x in w] + [ratios[twos[x, y] % 256] for x, y in zip(w, w[1:])]  # noqa: B905
        want[doc_id] = sum(grams) / len(grams)
    assert want[2] < want[4] < want[1]
    for threshold in (quality_rules.THRESHOLD, (want[2] + want[4]) / 2):
        got = {r["doc_id"]: r for r in quality_rules.score_documents(docs, marks, threshold=threshold, buckets=256).collect()}
        assert all(got[k]["score"] == pytest.approx(v) and got[k]["kept"] == (v >= threshold) for k, v in want.items())
        assert got[3]["kept"] is False and got[3]["score"] == 0


def test_log_ratios_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a", 0), (2, "b c", 0), (3, None, 0)], "doc_id long, text string, t int")
    got = quality_rules.log_ratios(docs, spark.createDataFrame([(1,)], "doc_id long"), 16)
    hashed = lambda *c: spark.range(1).select(F.xxhash64(*c)).first()[0]
    h = {w: hashed(F.lit(w)) for w in "abc"}
    grams = lambda ws: [h[w] % 16 for w in ws] + [hashed(F.lit(h[x]), F.lit(h[y])) % 16 for x, y in zip(ws, ws[1:])]  # noqa: E731, B905
    target, raw = Counter(grams("aba")), Counter(grams("aba") + grams("bc"))
    for b in range(16):
        want = math.log((target[b] + 1) / (5 + 16)) - math.log((raw[b] + 1) / (8 + 16))
        assert got[b] == pytest.approx(want)


def families(rng, n):
    """Texts in families of near copies around the threshold, exact copies, shared passages and short texts."""
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(n):
        base = [str(x) for x in rng.choice(vocabulary, rng.integers(3, 120))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for _ in range(rng.integers(0, 5)):
                copy[rng.integers(0, len(copy))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    return [*texts, "", " ", None, "one two", "ONE  two", "one two three four five"]


@pytest.mark.parametrize(("seed", "texts_an_id"), [(1, 1), (3, 2), (4, 3)])
def test_components_equal_brute_force(spark, seed, texts_an_id):
    """Also with several texts under one doc_id and with repeated rows."""
    rng = np.random.default_rng(seed)
    texts = families(rng, 60)
    if texts_an_id > 1:
        rng.shuffle(texts)
    rows = [(k // texts_an_id * 3 + 1, t) for k, t in enumerate(texts)]
    rows += rows[::7] if texts_an_id > 1 else []
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table).collect())
    sets, parent = [], {}
    for doc_id, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append((doc_id, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
        parent[doc_id] = doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, two in sets[:i]:
            common = len(one & two)
            if common and 100 * common >= 80 * (len(one) + len(two) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == Counter((d, len(s), find(d)) for d, s in sets)


def test_links_of_texts_under_one_id(spark):
    """Each id has two texts of different lengths, one of which is just similar enough to a text of another id."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(60):
        words = [f"v{k}x{i}" for i in range(45)]
        near = [*words, *(f"n{k}x{i}" for i in range(5))]
        other = [f"o{k}x{i}" for i in range(int(rng.integers(6, 30)))]
        rows += [(k, " ".join(words)), (k, " ".join(other)), (1000 + k, " ".join(near))]
        want[k] = want[1000 + k] = k
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == 180


def test_a_large_family_of_copies(spark):
    """Hundreds of variants of one text, a third too far from all others, and a passage that many texts share."""
    rng = np.random.default_rng(11)
    base, passage = [f"b{k}" for k in range(100)], [f"p{k}" for k in range(60)]
    rows = []
    for k in range(600):
        words = list(base)
        for at in rng.choice(100, 1 if k % 3 else 8, replace=False):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join([*passage, *(f"q{k}x{i}" for i in range(40))])) for k in range(600)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k for k in got if k >= 1000)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(96)} for k, t in rows[:600]}
    near = lambda a, b: len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])
    close = [k for k in range(600) if k % 3]
    linked = {k: k in close or any(near(k, x) for x in close) for k in range(600)}
    assert all((got[k] == 0 or got[k] == 1) if linked[k] else got[k] == k for k in range(600))


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    odds, moves, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    marginal, expected = line_crf.forward_backward(odds, first, moves)
    want, pairs = np.zeros(7), np.zeros((2, 2))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        n = hi - lo
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        weight = np.array([math.exp(sum(odds[lo + i] * y for i, y in enumerate(p)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            want[lo:hi] += w * np.array(p)
            for i in range(n - 1):
                pairs[p[i], p[i + 1]] += w
    assert np.allclose(marginal, want) and np.allclose(expected, pairs)


def test_long_chains_equal_short_ones():
    rng = np.random.default_rng(1)
    odds, moves, first = 3 * rng.normal(size=3000), rng.normal(size=(2, 2)), np.array([0, 1, 300, 301, 2000, 2990, 3000])
    want = line_crf.forward_backward(odds, first, moves, long_chain=3000)
    for most in (0, 1, 512):
        got = line_crf.forward_backward(odds, first, moves, long_chain=most)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_line_features_know_only_their_document():
    """Alone or in a block, read whole or in pieces that cut lines, a text has the same features and odds."""
    rng = np.random.default_rng(2)
    texts = [b"a b\n\ncc dd.\na b", b" lead\nxx", b"", b"x tail ", b"\n\n", b"x" * 50 + b"\nhello world\nhello world!\nhello world\n", "ÄÖ 日本\n日本".encode()]
    body, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    alone = [line_crf.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    assert np.allclose(line_crf.line_features(body, offsets)[0], np.concatenate([x for x, _, _ in alone]))
    width = 3 * line_crf.OWN + 2
    chain = line_crf.Chain(rng.normal(size=width + 1), rng.normal(size=(2, 2)), rng.normal(size=width), rng.uniform(0.5, 2, width))
    for text, (x, n, _) in zip(texts, alone, strict=True):
        for most in (1, 2, 5, 1000):
            odds, length = line_crf.long_odds(np.frombuffer(text, np.uint8), chain, most)
            assert np.allclose(odds, chain.odds(x)) and np.allclose(length, n)


def test_quality_of_a_text_of_many_lines(spark):
    """Over a megabyte in 200,000 lines has the score of its kind; in one line, of a length no label taught, it has some score."""
    good, bad = "A plain line of good words, which ends well.", "### $$$ %%% !!!! 11 22 ###"
    rows = [(k, "\n".join([good if k % 2 else bad] * (k % 7 + 1)), k % 2) for k in range(400)]
    marks = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    extra = [(1000, "\n".join([good] * 200_000)), (1001, "\n".join([bad] * 200_000)), (1002, (good + " ") * 40_000), (1003, (bad + " ") * 60_000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + extra, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in line_crf.score_documents(docs, marks).collect()}
    assert got[1000] >= line_crf.THRESHOLD > got[1001] and all(0 <= x <= 1 for x in got.values()) and set(got) == {k for k, _, _ in rows} | {1000, 1001, 1002, 1003}
    # Read in pieces, a text has the score that it has as a whole.
    chain = line_crf.train(line_crf.training_sample(docs, marks))
    for k, text in extra:
        body = np.frombuffer(text.encode(), np.uint8)
        x, n, first = line_crf.line_features(body, np.array([0, len(body)]))
        mean = line_crf.document_means(line_crf.marginals(chain.odds(x), first, chain.moves)[0], n, first)[0] * 10 - 5
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(chain.slope * mean + chain.offset, -30, 30)))) < 1e-6


def test_quality_on_held_out_rows(spark, data, docs):
    marks = spark.read.parquet(f"{data}/labels.parquet")
    rows = line_crf.score_documents(docs, marks).join(marks, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert len(rows) > 5 and sum(r[0] == r[1] for r in rows) >= 0.85 * len(rows)


def test_kneser_ney_sums_to_one():
    """Over all codes that follow a context, interpolated probabilities sum to one."""
    text = np.array([ord(c) for c in "  abracadabra  banana band "], np.uint16)
    codes, counts = np.unique(language.packed(text, np.array([0, len(text)])), return_counts=True)
    levels = language.kneser_ney(codes, counts)
    for context in ("  a", "bra", "zzz", "nan"):
        head = np.uint64(sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context)))
        every = head + np.arange(65536, dtype=np.uint64)
        assert np.exp(language.probabilities(levels, every)).sum() == pytest.approx(1.0, abs=1e-6)


def test_every_ngram_is_in_the_model(spark):
    """A language of more than 100,000 distinct 4-grams, each met once or twice."""
    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 120_000)))
    table = spark.createDataFrame([(k, t, "zh") for k, t in ((1, text), (2, text[:30_000]), (3, text[-5:]))], "doc_id long, text string, lang string")
    model = language.train(table, chosen=F.lit(True))
    want = Counter()
    for t in (text, text[:30_000], text[-5:]):
        points = np.array([32, *map(ord, t), 32], np.uint16)
        want.update(language.packed(points, np.array([0, len(points)]))[1:].tolist())
    codes = np.array(sorted(want), np.uint64)
    for got, expected in zip(model.levels[0], language.kneser_ney(codes, np.array([want[c] for c in codes.tolist()])), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(got, expected, strict=True))
    assert len(model.keys) == len(want) > 120_000


def test_languages_on_held_out_rows(docs):
    rows = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_rare_languages_reject_too(spark):
    """A language with 3 of 3,003 rows has its bound, whatever a sample of 2,000 would hold."""
    common = [(k, f"the house number {'abcdefghij'[k % 10]} stands by the road and the river runs past it", "en") for k in range(3000)]
    rare = [(10_000 + k, "kissa istuu ikkunalla ja katselee lunta joka sataa hiljaa", "fi") for k in range(3)]
    model = language.train(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"), calibration_docs=5, chosen=F.lit(True))
    assert np.isfinite(model.bound).all() and (model.mean > 0).all()
    got = language.identify(spark.createDataFrame([(1, "kkzqq ikkx jja uukkw lluuk", "fi"), (2, rare[0][1], "fi")], "doc_id long, text string, lang string"), model)
    assert {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in got.collect()} == {1: ("fi", True), 2: ("fi", False)}


def test_letters_beyond_the_basic_plane(spark):
    """Emoji are no letters; Deseret and Gothic ones are."""
    model = language.train(spark.createDataFrame([(k, "plain english words here", "en") for k in range(9)], "doc_id long, text string, lang string"), chosen=F.lit(True))
    texts = {1: "\U0001f600\U0001f680", 2: "\U0001f600 12 !", 3: "\U00010400\U00010428", 4: "\U00010330\U00010331 \U0001f600", 5: "words \U0001f600"}
    got = language.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "und", 2: "und", 3: "en", 4: "en", 5: "en"}


def test_few_own_texts_are_rejected(spark):
    """Texts like the known ones, kept out of the counts, are rejected at the stated share at most."""
    rng = np.random.default_rng(4)
    words = ["house", "river", "stands", "road", "near", "old", "tree", "water", "light", "green", "morning", "walks"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(3, 40))), "en") for k in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table.where("doc_id < 4000"), chosen=F.lit(True))
    fresh = language.identify(table.where("doc_id >= 4000"), model)
    assert fresh.where("rejected").count() <= 2 * language.REJECT_SHARE * 2000


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] += r["size"]
    total = sum(v[2] for v in by.values())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * by[s][2] for s in capped)
        share = {s: rest * weights[s] / sum(weights[x] for x in by if x not in capped) for s in by if s not in capped}
        over = {s for s in share if share[s] > 3 * by[s][2]}
        if not over:
            break
        capped |= over
    target = {s: share.get(s, 3.0 * by[s][2]) for s in by}
    for s, (taken, told, _) in by.items():
        assert told == pytest.approx(target[s]) and taken == pytest.approx(told, rel=0.02, abs=50)


def test_mix_caps_small_sources(spark):
    docs = spark.createDataFrame([(k, "w " * 100, "a" if k < 2 else "b", 1) for k in range(100)], "doc_id long, text string, source string, target int")
    got = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert got["a"]["target"] == 600 and got["a"]["taken"] <= 600 and got["b"]["target"] == pytest.approx(9400)


def unigram_model():
    """A small unigram model file, written field by field."""
    from struct import pack

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
    flag = lambda k, v: varint(k << 3) + varint(v)
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces_ += [("▁", -2.0, 1), ("▁the", -2.5, 1), ("he", -3.0, 1), ("t", -4.0, 1), ("h", -4.1, 1), ("e", -3.9, 1), ("▁a", -3.0, 1), ("s", -4.2, 1), ("▁theses", -6.5, 1), ("es", -3.5, 1), ("a", -4.0, 1)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + pack("<f", s) + flag(3, k)) for p, s, k in pieces_)
    return body + field(2, flag(3, 1) + flag(35, 1)) + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 1) + flag(5, 1))


@pytest.mark.parametrize("model", [pieces.read_model(), unigram_model()], ids=["bpe", "unigram"])
def test_parity_with_the_reference_encoder(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    parsed = pieces.PieceModel.parse(model)
    tokenizer, table = pieces.build_tokenizer(parsed), pieces.piece_bytes(parsed)
    for text in ["", "the theses", " the  hats a ", "a\nb\tc", "<s> the </s> <0x41>", "äöü 日本 😀", "the" * 200, "x  y", "e", " "]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == library.encode(text), text
        assert pieces.decode_ids(table, ids, parsed.dummy_prefix) == library.decode(ids), text


def test_encoding_round_trip(spark, docs):
    model = pieces.read_model()
    got = pieces.encode(docs.select("doc_id", "text"), model, parity_every=1)
    assert got.where("not parity or not decoded_ok").count() == 0
    back = pieces.decode(got.select("doc_id", "text", "ids"), model)
    assert back.where("text <> decoded").count() == 0


def test_every_row_is_compared_with_the_library(spark, data):
    rows = [(None if k % 3 == 0 else k, f"text {k} ▁▁ <s> 日本") for k in range(60)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), pieces.read_model())
    assert got.where("parity is null").count() == 0
    assert QUERIES["op9_sentencepiece"](spark, data).where("parity is null").count() == 0


TALK = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hello <|im_end|> there"), (1, 2, "assistant", "a <\\|im_start|> b"), (1, 3, "user", None), (1, 4, None, "no role"), (1, 5, "assistant", ""),
    (2, 0, "assistant", "x " * 900), (2, 1, "assistant", "y " * 30), (2, 2, "user", "z " * 30), (2, 2, "user", "z " * 30), (2, 3, "assistant", "ä😀\n" * 40), (3, None, "us\\er\n", "<<\\\\||>"), (None, 1, "assistant", "alone"),
]


@pytest.mark.parametrize("budget", [(64, 16), (1024, 256), (5000, 0)])
def test_chat_round_trip(spark, budget):
    table = spark.createDataFrame([(*t, "x") for t in TALK], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(table, *budget)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    order = sorted(TALK, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
    for conv in {t[0] for t in TALK}:
        turns = [(t[2] or "", t[3] or "") for t in order if t[0] == conv]
        target = "".join(x for r, x in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    for r in windows.collect():
        assert r["text"].count(chat.START) == r["repeated"] + r["own"] and r["own"] > 0
        assert r["tokens"] <= budget[0] or r["own"] == 1
