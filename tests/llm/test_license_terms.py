"""What a window's features are made of is hashed once a paragraph, and is the same as of the window on its own."""

from pyspark.sql import functions as F

from fieldweave.llm import license_scan


def test_windows_terms_are_those_of_their_own_words(spark):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (1, 2, 64, 65, 96, 97, 200)] + ["a b a\n\nb", None, " "]
    rows = license_scan.windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    own = F.concat(license_scan._ones(F.col("words")), license_scan._twos(license_scan._ones(F.col("words"))))
    got = rows.select("doc_id", "words", "terms", own.alias("own")).collect()
    for r in got:
        assert r["terms"] == r["own"] and len(r["terms"]) == 2 * len(r["words"]) - 1
    for k, text in enumerate(texts[:7]):
        starts = range(0, max(len(text.split()) - (license_scan.WINDOW - license_scan.STRIDE) - 1, 0) + 1, license_scan.STRIDE)
        assert sorted(r["words"] for r in got if r["doc_id"] == k) == sorted(text.split()[s : s + license_scan.WINDOW] for s in starts)


def test_gate_is_its_pattern(spark):
    blocks = ["LICENSE here", "relicense", "Permission", "a permitted B", "SPDX-License-Identifier: MIT", "lorem ipsum", "under the terms", "İlicense", "conditions"]
    rows = spark.createDataFrame([(b,) for b in blocks], "b string").select("b", license_scan.gated(F.col("b")).alias("got"), F.col("b").rlike(license_scan.GATE).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and len({r["got"] for r in rows}) == 2
