"""Every operator over the edge rows and over empty tables."""

import zlib

import pytest
from edge_rows import documents, labels
from pyspark.sql import functions as F

from fieldweave.llm import chat, jaccard, language, license_scan, line_crf, mixing, pieces, quality_rules, sharding, topk


def operators(docs, marks):
    return {
        "license_scan": lambda: license_scan.scan(docs),
        "quality_rules": lambda: quality_rules.score_documents(docs, marks, buckets=256),
        "jaccard": lambda: jaccard.near_duplicates(docs),
        "sharding": lambda: sharding.shard_manifest(docs, 8),
        "line_crf": lambda: line_crf.score_documents(docs, marks, keep=("doc_id", "score", "text")[:1]),
        "language": lambda: language.identify(docs, language.train(docs)),
        "mixing": lambda: mixing.mix(docs),
        "pieces": lambda: pieces.encode(docs, pieces.read_model()),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, name):
    docs = documents(spark)
    rows = operators(docs, labels(spark))[name]().collect()
    if name == "license_scan":
        assert len(rows) == 12 and {r["licence"] for r in rows} == {"none"}
    else:
        assert len(rows) == 13


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert operators(documents(spark, True), labels(spark, True))[name]().count() == 0


def test_empty_conversations_and_vectors(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, window int")
    assert chat.read_back(chat.format_windows(none)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, score int")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_sharding_by_hand(spark):
    """Jump hash and slots against plain Python."""

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    docs = documents(spark)
    keys = {r[0]: r[1] % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    rows = sharding.shard_manifest(docs, 8).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    slots = {}
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (jump(keys[r["doc_id"]], 8), jump(keys[r["doc_id"]], 9))
        assert r["grown_shard"] in (r["shard"], 8)
        assert r["text_crc32"] in {zlib.crc32(t.encode()) for t in texts[r["doc_id"]]}
        assert r["size"] in {len(t.encode()) + 1 for t in texts[r["doc_id"]]}
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
