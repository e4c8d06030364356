"""Rows of the join of buckets: those from which no link can come end in the join itself."""

import random

from pyspark.sql import functions as F

from fieldweave.llm import jaccard


def test_rows_without_room_for_a_link_do_not_fit(spark):
    """Two sets of 90 of which one has the shingle late, and sets of sizes 80 and 100 of which both have it late."""
    rows = [(0, 90, 0, 90, 0), (1, 90, 0, 90, 60), (2, 80, 0, 100, 20), (3, 80, 1, 100, 0), (4, 90, 10, 90, 10), (5, 90, 11, 90, 0)]
    got = spark.createDataFrame(rows, "id int, n_a long, pos_a long, n_b long, pos_b long").where(jaccard._fits("a", "b", 80))
    assert sorted(r["id"] for r in got.collect()) == [0, 2, 4]


def test_first_common_shingle_of_linked_sets_fits(spark):
    """Random pairs of ordered sets: the first common element of every linked pair fits, at the bound too."""
    rng, rows = random.Random(4), []
    for k in range(3000):
        n, m = rng.randrange(1, 40), rng.randrange(0, 9)
        one = set(rng.sample(range(100), n))
        two = set(rng.sample(sorted(one), max(n - m, 0))) | set(rng.sample(range(100), rng.randrange(0, 6)))
        both = one & two
        if both and 100 * len(both) >= 80 * len(one | two):
            first = min(both)
            rows.append((k, len(one), sorted(one).index(first), len(two), sorted(two).index(first)))
    assert len(rows) > 300
    got = spark.createDataFrame(rows, "id int, n_a long, pos_a long, n_b long, pos_b long")
    assert got.where(~F.coalesce(jaccard._fits("a", "b", 80), F.lit(False))).isEmpty()
