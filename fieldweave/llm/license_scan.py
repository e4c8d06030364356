"""Licence families of documents' paragraphs, in DataFrame functions only.

A paragraph is a block of lines between blank ones; line feeds inside it are blanks. Every paragraph is read in overlapping
windows of words, all of them, so that a notice is whole in some window wherever it stands and however it is wrapped, and a
reworded one is told as `unknown` whatever words it has left. A window's hashed word
unigrams and bigrams are its sparse features, and are hashed once a paragraph, before windows are cut; a multinomial logistic regression over them gives a probability to each
licence family and to `none`. The model is trained here: on the families' templates among filler of many lengths, up to a
full window of which the template is anywhere, and on windows sampled from the corpus, which are `none` unless they match
a template; half of these from paragraphs with one of the words of `GATE`, which are in all that comes near a template, the
others from all.

Every window is scored once. What is likelier of a family than `none` is written, and read for calibration and judgement.

The unknown class is calibrated over all documents: the least family probability that counts as a prediction is what at
most a `false_share` of all paragraphs reach in windows that match no template, within `LEAST` and `MOST`; a window whose
likeliest class is a family but below that is `unknown`. `MOST` keeps licences of unlisted families, where they are
common, from hiding the listed ones. A prediction is confirmed if the window holds at least `CONFIRM` of the word bigrams of
one of the family's templates; an unconfirmed one is `unknown` too. A paragraph takes its best window: confirmed ones
before unknown ones, by probability.

Bounds: the training sample has at most about `sample_docs` documents, picked by hash, and of them at most `TRAIN_WINDOWS`
windows.

Edge cases: null, empty and blank texts have no paragraph and no licence; rows of one doc_id count as one document;
repeated paragraphs count each time; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import Scratch

# Phrases by which each licence family names or grants itself.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
}
# Fixed values end.

NONE, UNKNOWN = "none", "unknown"
FEATURES, SAMPLE_DOCS, TRAIN_WINDOWS, FALSE_SHARE, CONFIRM = 1 << 15, 400, 4000, 1e-3, 0.6
#: Range of the calibrated probability.
LEAST, MOST = 0.5, 0.95
#: Words of a window, and how far the next one starts behind it; a template fits into their difference.
WINDOW, STRIDE = 64, 32
#: Words of filler about a template in training: so many before and behind it, cut at the window's end.
PADDING = ((0, 0), (0, 6), (3, 2), (8, 12), (16, 0), (0, 24), (20, 14), (0, 64), (8, 64), (16, 64), (24, 64), (32, 64))
#: Windows that filler is taken from; of a template's words in training every ninth is left out in so many more variants.
FILLERS, VARIANTS, NINTH = 1000, 3, 9
FAMILIES = [NONE, *sorted(TEMPLATES)]


def gate_words(least: int = 5) -> list[str]:
    """Words, at word starts, one of which is in any text that has the share `CONFIRM` of a template's bigrams.

    Words of `least` letters or more are taken one by one, each time the one whose bigrams bring most templates nearest
    below that share.
    """
    left = []
    for text in (t for texts in TEMPLATES.values() for t in texts):
        words = [re.findall(r"[^\W_]+", w) for w in text.lower().split() if re.search(r"[^\W_]", w)]
        pairs = [frozenset(map(tuple, p)) for p in dict.fromkeys((tuple(a), tuple(b)) for a, b in zip(words, words[1:], strict=False))]
        left.append((len(pairs), {p for p in pairs}))
    held = lambda pair, word: any(part.startswith(word) for token in pair for part in token)
    known = sorted({part for _, pairs in left for pair in pairs for token in pair for part in token if len(part) >= least})
    chosen: list[str] = []
    while any(len(pairs) >= CONFIRM * n for n, pairs in left if n):
        open_ = [(n, pairs) for n, pairs in left if n and len(pairs) >= CONFIRM * n]
        chosen.append(max(known, key=lambda w: (sum(sum(held(p, w) for p in pairs) / n for n, pairs in open_), w)))
        left = [(n, {p for p in pairs if not held(p, chosen[-1])}) for n, pairs in left]
    return chosen


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits with what joins them inside a word, such as `cc`, `by-nc` or `4.0`."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[^\x20\x09-\x0D\p{L}\p{N}]+[\p{L}\p{N}]+)*"), F.lit(0))


#: What every paragraph has that could be confirmed; half of the training sample is taken from such ones.
GATE = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(gate_words())})"


def gated(block: Column) -> Column:
    """Whether a paragraph matches `GATE`; the pattern is tried only where a word of it is found at all, which is faster."""
    low = F.lower(block)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in gate_words()]) & block.rlike(GATE)


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def blocks(text: Column) -> Column:
    """The paragraphs of a text that have a letter or digit, as an array of strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[\x20\x09\x0B-\x0D]*\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _ones(words: Column) -> Column:
    """Hashes of words: what features are made of. They are hashed, and paired, as numbers, not as texts."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _twos(ones: Column) -> Column:
    """Hashes of neighbours."""
    n = F.greatest(F.size(ones) - 1, F.lit(0))
    return F.zip_with(F.slice(ones, F.lit(1), n), F.slice(ones, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def windows(docs: DataFrame, gate: bool = False) -> DataFrame:
    """doc_id, place (a key of the paragraph), words and terms of every window of the paragraphs, or of those of the gate.

    Hashes are made of the paragraph, and windows are cut from it before rows multiply: each word is hashed once, though
    windows overlap, and no window's row carries the whole paragraph.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(blocks(F.col("text"))).alias("at", "block"))
    if gate:
        lines = lines.where(gated(F.col("block")))
    words = lines.select("doc_id", F.struct("text_hash", "at").alias("place"), tokens(F.col("block")).alias("words"))
    words = words.select("*", _ones(F.col("words")).alias("ones")).select("*", _twos(F.col("ones")).alias("twos"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - (WINDOW - STRIDE) - 1, F.lit(0)), F.lit(STRIDE))
    cut = F.transform(starts, lambda s: F.struct(F.slice("words", s + 1, WINDOW).alias("words"), F.concat(F.slice("ones", s + 1, WINDOW), F.slice("twos", s + 1, WINDOW - 1)).alias("terms")))
    return words.select("doc_id", "place", F.explode(cut).alias("window")).select("doc_id", "place", "window.words", "window.terms")


def templates(spark: SparkSession) -> DataFrame:
    """family, words and bigrams of each template."""
    rows = spark.createDataFrame([(k, t) for k in sorted(TEMPLATES) for t in TEMPLATES[k]], "family string, text string").coalesce(1)
    return rows.select("family", tokens(F.col("text")).alias("words")).select("family", "words", bigrams(F.col("words")).alias("pairs"))


def _features(rows: DataFrame) -> DataFrame:
    """Adds features, from terms."""
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES).transform(rows)


def _share(pairs: Column, spark: SparkSession, families: list[str]) -> Column:
    """The largest share of a template's bigrams that `pairs` holds, for each family in turn. Templates are constants."""
    known: dict[str, list] = {}
    for row in templates(spark).collect():
        known.setdefault(row["family"], []).append(row["pairs"])

    def best(family: str) -> Column:
        shares = [F.size(F.array_intersect(pairs, F.array(*map(F.lit, dict.fromkeys(t))))) / float(len(set(t))) for t in known[family] if t]
        return F.greatest(*shares) if len(shares) > 1 else shares[0]

    return F.array(*[F.lit(0.0) if f == NONE else best(f) for f in families])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LogisticRegressionModel:
    """The model, from templates and a bounded sample of windows."""
    spark = docs.sparkSession
    ids = docs.where("text is not null").select(F.col("doc_id").alias("s_id")).distinct().orderBy(F.xxhash64("s_id"), "s_id").limit(sample_docs)
    lines = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("s_id")).select(F.explode(blocks(F.col("text"))).alias("block"))
    sample = lines.select(F.slice(tokens(F.col("block")), 1, WINDOW).alias("words")).orderBy(F.xxhash64("words"), "words").limit(TRAIN_WINDOWS // 2)
    sample = sample.unionByName(windows(docs, gate=True).select("words").orderBy(F.xxhash64("words"), "words").limit(TRAIN_WINDOWS // 2))
    # Windows with some of a template are of no class: they may be a part of a notice.
    plain = Scratch(spark).write(sample.where(F.array_max(_share(bigrams(F.col("words")), spark, FAMILIES)) < CONFIRM / 3), "plain")
    fillers = plain.where(F.size("words") >= 8).orderBy(F.xxhash64("words", F.lit(1)), "words").limit(FILLERS).collect()
    fillers = [list(r["words"]) for r in fillers] or [["the", "and", "text", "of", "this", "file"]]
    made = []
    for row in templates(spark).orderBy("family", "words").collect():
        for k, (before, behind) in enumerate(PADDING * VARIANTS):
            filler = fillers[len(made) % len(fillers)] * WINDOW
            words = row["words"] if k < len(PADDING) else [w for i, w in enumerate(row["words"]) if i % NINTH != k % NINTH]
            made.append((float(FAMILIES.index(row["family"])), 10.0, [*filler[:before], *words, *filler[before : before + behind]][:WINDOW]))
    positive = spark.createDataFrame(made, "label double, weight double, words array<string>")
    rows = positive.unionByName(plain.select(F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"), "words")).coalesce(1)
    rows = rows.select("*", F.concat(_ones(F.col("words")), _twos(_ones(F.col("words")))).alias("terms"))
    return LogisticRegression(family="multinomial", regParam=1e-4, maxIter=30, weightCol="weight").fit(_features(rows))


def calibrated(scored: DataFrame, paragraphs: int, false_share: float = FALSE_SHARE) -> float:
    """The least probability of a prediction: what at most `false_share` of all paragraphs reach in windows of no template.

    `scored`: doc_id, place, p and most (the largest share of any template) of windows likelier of a family than none.
    """
    top = scored.where(F.col("most") < CONFIRM).groupBy("doc_id", "place").agg(F.max("p").alias("p"))
    some, allowed = top.count(), false_share * paragraphs
    least = top.agg(F.percentile_approx("p", 1.0 - allowed / some, 10_000)).first()[0] if some > allowed else LEAST
    return min(max(LEAST, least), MOST)


def _predicted(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Rows likelier of a family than none, with p, the largest probability of a family, and family, its name.

    The few are picked by the model's prediction, one column, so that what tells p and family is not worked out for all.
    """
    likely = model.transform(_features(rows)).where(F.col("prediction") != FAMILIES.index(NONE))
    scored = likely.select(*rows.columns, F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1).alias("ps")).select(*rows.columns, F.array_max("ps").alias("p"), "ps")
    return scored.select(*rows.columns, "p", F.element_at(F.array(*map(F.lit, FAMILIES[1:])), F.array_position("ps", F.col("p")).cast("int")).alias("family"))


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, false_share: float = FALSE_SHARE) -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_licensed, n_unknown, families (sorted, distinct), licence.

    licence is the family with most confirmed paragraphs (ties by name), else `unknown` or `none`.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = _predicted(windows(docs), train(docs, sample_docs))
    shares = _share(bigrams(F.col("words")), spark, FAMILIES[1:])
    own = F.element_at("shares", F.array_position(F.array(*map(F.lit, FAMILIES[1:])), F.col("family")).cast("int"))
    rows = scratch.write(rows.withColumn("shares", shares).select("doc_id", "place", "p", "family", own.alias("near"), F.array_max("shares").alias("most")), "scored")
    paragraphs = scratch.write(docs.select("doc_id", F.size(blocks(F.col("text"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_paragraphs")), "paragraphs")
    least = calibrated(rows, paragraphs.agg(F.sum("n_paragraphs")).first()[0] or 0, false_share)
    sure = (F.col("p") >= least) & (F.col("near") >= CONFIRM)
    judged = rows.select("doc_id", "place", F.struct(sure.alias("sure"), "p", F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("found")).alias("best"))
    judged = judged.groupBy("doc_id", "place").agg(F.max("best").alias("best")).select("doc_id", F.col("best.found").alias("found"))
    found = judged.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.sum(F.when(F.col("found") != UNKNOWN, 1).otherwise(0)).alias("n_licensed"),
        F.sum(F.when(F.col("found") == UNKNOWN, 1).otherwise(0)).alias("n_unknown"),
        *[F.sum(F.when(F.col("found") == f, 1).otherwise(0)).alias(f"_{f}") for f in FAMILIES[1:]],
    )
    counts = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"`_{f}`")).alias("minus"), F.lit(f).alias("family")) for f in FAMILIES[1:]]), lambda x: x["minus"] < 0))
    found = found.select("l_id", "n_licensed", "n_unknown", counts.alias("counts"))
    joined = paragraphs.join(found, paragraphs.doc_id.eqNullSafe(found.l_id), "left")
    families = F.array_join(F.array_sort(F.transform("counts", lambda x: x["family"])), ",")
    licence = F.coalesce(F.get("counts", F.lit(0))["family"], F.when(F.col("n_unknown") > 0, UNKNOWN).otherwise(NONE))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_paragraphs", "n_licensed", "n_unknown")]
    return joined.select("doc_id", *zero, F.coalesce(families, F.lit("")).alias("families"), licence.alias("licence"))
