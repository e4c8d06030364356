"""Quality rules and importance weights of documents, in SQL functions only.

The method's verdict compares two multinomials over hashed word n-grams: a trusted target and the raw corpus.
A document's score is the mean over its n-grams of log(p_target / p_raw); it is kept at `threshold` or above.
Raw counts cover every n-gram of every document; the target is fitted on a bounded sample of labelled rows.

Edge cases: null and empty texts have no words and fail the base rule (fewer than `min_words`); their score is 0.
Repeated rows are scored alike; without trusted rows the two multinomials are taken as equal, so every score is 0.
An empty table gives an empty result. Only the named columns of the input are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import WORD_CLASS, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Hash buckets of the n-grams (unigrams and bigrams).
BUCKETS = 1 << 16
#: At most so many labelled rows make the trusted target.
TRUSTED_ROWS = 20_000
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _windows(hashes: Column) -> Column:
    """A 64-bit hash of each 3-word window."""
    return F.transform(F.slice(hashes, F.lit(3), F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h))


def base_rules(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes (one 64-bit hash a word).

    Each step is a projection of its own, so arrays are built once a document. Windows sorted by (hash, place) have equal
    ones side by side; their places, in order, each cover up to three words that no earlier window covers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = docs.select("doc_id", text.alias("text")).select("doc_id", "text", words_of(F.col("text")).alias("words"))
    one = zero.select(
        "doc_id",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD_CLASS)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    two = one.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("hashes").cast("long").alias("n_words"),
        "hashes",
        _windows(F.col("hashes")).alias("windows"),
    )
    three = two.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("tagged"))
    same = lambda x, k: (F.get(F.col("tagged"), k - 1)["h"] == x["h"]) | F.coalesce(F.get(F.col("tagged"), k + 1)["h"] == x["h"], F.lit(False))
    four = three.select("*", F.sort_array(F.transform(F.filter("tagged", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])).alias("places"))
    cover = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")), lambda s, p: F.struct((s["n"] + (p + 3) - F.greatest(p, s["end"])).cast("long").alias("n"), (p + 3).alias("end")), lambda s: s["n"])
    return four.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(cover, F.lit(0)).alias("n_repeat_words"), "hashes")


def base_failed() -> Column:
    """The verdict of the base columns."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _buckets(hashes: Column, buckets: int) -> Column:
    """Bucket of each unigram, then of each bigram."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)))
    twos = F.transform(F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)))
    return F.concat(ones, twos)


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(p_target / p_raw) of each bucket, both with one added count a bucket. `trusted_ids`: a bounded table of doc_id.

    One pass: every document's n-grams go to partial counts by bucket, so the shuffle is a row for each bucket and task.
    """
    flag = F.broadcast(trusted_ids.select(F.col("doc_id").alias("trusted_id")).distinct())
    hashed = docs.join(flag, docs.doc_id == flag.trusted_id, "left").select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    grams = hashed.select("t", F.explode(_buckets(F.col("hashes"), buckets)).alias("bucket"))
    found = {r[0]: (r[1], r[2]) for r in grams.groupBy("bucket").agg(F.sum("t"), F.count("*")).collect()}
    target, raw = sum(x for x, _ in found.values()), sum(y for _, y in found.values())
    if not target:
        return [0.0] * buckets
    shift = math.log(raw + buckets) - math.log(target + buckets)
    return [math.log(x + 1) - math.log(y + 1) + shift for x, y in (found.get(b, (0, 0)) for b in range(buckets))]


def trusted_sample(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """At most `limit` doc_ids with quality 1, picked by hash: the bounded labelled sample of the target."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """Base rules, score and verdict of every document."""
    weights = ",".join(repr(x) for x in log_ratios(docs, trusted_sample(labels, trusted_rows), buckets))
    table = F.split(F.lit(weights), ",").cast("array<double>")
    rows = base_rules(docs)
    total = F.aggregate(_buckets(F.col("hashes"), buckets), F.lit(0.0), lambda s, b: s + F.get(table, b.cast("int")))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    scored = rows.select(*rows.columns[:-1], base_failed().alias("base_failed"), (total / grams).alias("score"))
    return scored.select("*", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
