"""Exact set-similarity join of documents on word shingles, by a grouped prefix join, and its connected components.

The nodes are distinct shingle sets; equal sets are one node, so copies never meet pair by pair. Shingles are put in one
global order, those of few nodes first. Two sets of similarity t or more then share a shingle among the first
(1 - t) n + 1 of each. Sets with the same size and the same such prefix form one group, which stands in the join once: its
prefix shingles make rows, and shingles met in two groups or more make buckets.

How many nodes hold a shingle is counted exactly, in two steps. A set can link only if all but (1 - t) n of its shingles
are in other sets too. So of every set the `SAMPLED` share of least hash goes through a first count; a set in which more
than (1 - t) n of these are its own alone is done. All shingles of the sets that are left are then counted among them by
one shuffle of (shingle, node). A shingle of one node alone is first in order and can meet nothing, so it takes up its
places of the prefix without ever becoming a row again.

Shingles that a bounded summary of the first pass finds in a share of the rows that would fill a task are kept out of
these counts: they are taken for shared, come last in order, by their summary, and are emitted only as far as a prefix
needs them. What the summary misses is counted like any other, so it steers balance and cost, never the result.

Components need no list of all pairs. In a star round every bucket offers its groups paired with one of them (the hub;
first the one with the fewest rarer shingles, later one by hash), the pairs are verified, and links are contracted to
components; a bucket whose groups have all come together is done. After the star rounds, whatever pairs of groups in
different components still share a bucket are all filtered by size, position and bitmap, expanded into pairs of members
and verified, so no link between components is lost. Verification compares whole shingle sets.

The bitmap of a set has bit h mod its width flipped by each shingle h. Bits in which two bitmaps differ are at most the
shingles that only one of the sets has, so pairs that differ in too many bits can't link. A narrow bitmap travels with
the buckets, a wide one is compared for the pairs that are left. Groups of several members have none and are always
expanded.

Edge cases: a document without words or text has no shingles, links with nothing and is its own component; texts of
fewer words than a shingle are one shingle; rows of one doc_id are one document, linked by any of its texts, and each
row tells its own text's number of shingles; a null doc_id has no component and links with nothing; an empty table gives
an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import Scratch
from fieldweave.llm.shingles import WORDS, mixed, shingle_sets
from fieldweave.llm.textblocks import blocks

PERCENT = 80
#: Most shingles that are kept out of the count; shingles summarised at once; the share of a run (and the least number) that puts one in its summary.
HEAVY, RUN_SHINGLES, RUN_SHARE, RUN_LEAST = 200_000, 2_000_000, 1e-5, 3
#: Added to the rank of shingles kept out of the count, so that they come after all counted ones.
LAST = 1 << 60
#: Share of a set's shingles, in percent and beyond those it may have alone, that the first count looks at.
SAMPLED = 10
STAR_ROUNDS = 3
#: 64-bit words of a set's narrow and wide bitmaps.
NARROW, WIDE = 4, 32
#: Rows of a label table that one task takes.
LABEL_ROWS = 200_000


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles one after the other, where each set starts (and the end), sizes, and two hashes of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, start = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        runs = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x), dtype=np.uint64)]) for x in (flat + np.uint64(1), flat ^ np.uint64(0x5851F42D4C957F2D))]
        fp1, fp2 = ((run[start[1:]] - run[start[:-1]]).view(np.int64) for run in runs)
    return flat, start, sizes, fp1, fp2


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, text_hash, n and fp1, fp2 of its set. Rows without n tell a shingle often met in a run of rows."""
    names = ["doc_id", "text_hash", "n", "fp1", "fp2", "shingle", "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def summary() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(RUN_LEAST, RUN_SHARE * size)
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([*[none] * 5, pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names)

        for batch in batches:
            for lo, hi, body, offsets in blocks(batch.column(2)):
                sets = shingle_sets(body, offsets, words)
                _, _, sizes, fp1, fp2 = _fingerprints(sets)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], pa.array(sizes), pa.array(fp1), pa.array(fp2), none, none], names)
                held += sets
                size += int(sizes.sum())
                if size >= RUN_SHINGLES:
                    yield summary()
                    held, size = [], 0
        if held:
            yield summary()

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _bitmaps(shingles: np.ndarray, owner: np.ndarray, sets: int, words: int) -> pa.Array:
    """The bitmap of each set as a list of `words` 64-bit words: a bit is the parity of the shingles that fall on it."""
    width = 64 * words
    odd = (np.bincount(owner * width + (shingles % np.uint64(width)).astype(np.int64), minlength=sets * width) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(sets, width), axis=1).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, sets * words + 1, words, dtype=np.int32)), pa.array(packed))


def _prefix_size(n: Column | np.ndarray, percent: int):
    """Places of the prefix of a set of n shingles: floor((1 - t) n) + 1."""
    return (n * (100 - percent) / 100).cast("long") + 1 if isinstance(n, Column) else n * (100 - percent) // 100 + 1


def _places(sets: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Rank (from 1) of each shingle among the heavy ones; 0 for light ones."""
    if not len(heavy):
        return np.zeros(len(sets), np.int64)
    by_hash = np.argsort(heavy)
    ordered = heavy[by_hash]
    at = np.minimum(np.searchsorted(ordered, sets), len(heavy) - 1)
    return np.where(ordered[at] == sets, by_hash[at] + 1, 0)


def _linkable(docs: DataFrame, heavy: np.ndarray, percent: int, words: int) -> DataFrame:
    """fp1 of the sets that may link: of their sampled light shingles not too many are in no other set."""
    names = ["own", "alone", "sampled", "shingle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for lo, hi, body, offsets in blocks(batch.column(0)):
                flat, start, sizes, fp1, _ = _fingerprints(shingle_sets(body, offsets, words))
                size += len(flat)
                if size > RUN_SHINGLES:  # copies are left out within a run of rows
                    seen, size = set(), len(flat)
                fresh = np.zeros(hi - lo, bool)
                for k, fp in enumerate(fp1.tolist()):
                    if fp not in seen and 100 * sizes[k] >= percent * (sizes[k] + 1):
                        fresh[k] = True
                        seen.add(fp)
                owner = np.repeat(np.arange(hi - lo), sizes)
                light = _places(flat, heavy) == 0
                before = np.concatenate([[0], np.cumsum(light)])
                nth = before[:-1] - before[start[owner]]  # light ones of the set ahead of this one
                alone = _prefix_size(sizes, percent) - 1
                emit = light & fresh[owner] & (nth < (alone + 1 + sizes * SAMPLED // 100)[owner])
                sampled = np.bincount(owner[emit], minlength=hi - lo)
                who = owner[emit]
                rows = [fp1[who], alone[who], sampled[who], flat[emit].view(np.int64)]
                # A set with too few light shingles to tell: one row without a shingle.
                sure = np.flatnonzero(fresh & (sampled <= alone))
                nulls = [fp1[sure], alone[sure], sampled[sure]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])) for x, y in zip(rows[:3], nulls, strict=True)] + [pa.concat_arrays([pa.array(rows[3]), pa.nulls(len(sure), pa.int64())])], names)

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    rows = rows.withColumn("key", F.coalesce("shingle", "own"))
    each = Window.partitionBy("key")
    once = rows.select("*", F.lag("own").over(each.orderBy("own")).alias("last")).where("last is null or last <> own")
    shared = once.select("own", "alone", "sampled", "shingle", F.min("own").over(each).alias("lo"), F.max("own").over(each).alias("hi")).where("lo < hi or shingle is null")
    some = shared.groupBy("own").agg(F.first("alone").alias("alone"), F.first("sampled").alias("sampled"), F.count("shingle").alias("shared"))
    return some.where("sampled - shared <= alone").select(F.col("own").alias("fp1"))


def _candidates(texts: DataFrame, heavy: np.ndarray, percent: int, words: int) -> DataFrame:
    """node, n, light, shingle, rank: rows of all light shingles of each node (rank 0), and of as many heavy ones, in
    order of their rank, as its prefix needs beyond them. light: the node's number of light shingles."""
    names = ["node", "n", "light", "shingle", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, one, two = (batch.column(k).to_numpy() for k in range(4))
            for lo, hi, body, offsets in blocks(batch.column(4)):
                flat, start, sizes, fp1, fp2 = _fingerprints(shingle_sets(body, offsets, words))
                own = (sizes == n[lo:hi]) & (fp1 == one[lo:hi]) & (fp2 == two[lo:hi])
                owner = np.repeat(np.arange(hi - lo), sizes)
                place = _places(flat, heavy)
                light = np.bincount(owner[place == 0], minlength=hi - lo)
                want = np.maximum(_prefix_size(sizes, percent) - light, 0)
                emit = (place == 0) & own[owner]
                for k in np.flatnonzero(own & (want > 0)):
                    span = np.arange(start[k], start[k + 1])[place[start[k] : start[k + 1]] > 0]
                    emit[span[np.argsort(place[span], kind="stable")[: want[k]]]] = True
                who = owner[emit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[lo:hi][who], sizes[who], light[who], flat[emit].view(np.int64), place[emit])], names)

    return texts.select("node", "n", "fp1", "fp2", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """node, n, pos, shingle: the places of each node's prefix, without the shingles that no other node has."""
    each = Window.partitionBy("shingle")
    counted = rows.where("rank = 0").select("*", F.count("*").over(each).alias("nodes")).where("nodes > 1")
    both = counted.select("node", "n", "light", "shingle", "nodes").unionByName(rows.where("rank > 0").select("node", "n", "light", "shingle", (F.col("rank") + LAST).alias("nodes")))
    node = Window.partitionBy("node")
    placed = both.select("*", F.row_number().over(node.orderBy("nodes", "shingle")).alias("place"), F.count(F.when(F.col("nodes") < LAST, 1)).over(node).alias("shared"))
    return placed.select("node", "n", (F.col("light") - F.col("shared") + F.col("place") - 1).alias("pos"), "shingle").where(F.col("pos") < _prefix_size(F.col("n"), percent))


def _with_bitmaps(texts: DataFrame, words: int) -> DataFrame:
    """node, text, bits and wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, offsets in blocks(batch.column(1)):
                flat, _, sizes, _, _ = _fingerprints(shingle_sets(body, offsets, words))
                maps = [_bitmaps(flat, np.repeat(np.arange(hi - lo), sizes), hi - lo, w) for w in (NARROW, WIDE)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], *maps], ["node", "text", "bits", "wide"])

    return texts.select("node", "text").mapInArrow(run, "node long, text string, bits array<long>, wide array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets are similar enough. One text a pair goes through the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                two = [[s for _, _, body, offsets in blocks(part.column(k)) for s in shingle_sets(body, offsets, words)] for k in (2, 3)]
                hit = []
                for x, y in zip(*two, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                mask = pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    side = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = side.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, tasks: int = 1) -> DataFrame:
    """node, component (its smallest reachable node) for every node of `edges` (a, b).

    Each round a node takes the least label among its neighbours' and then the label of its label; labels only fall, so
    an unchanged sum ends the rounds. Long chains shrink by the second step. `tasks`: how many share a table of labels.
    """
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct().coalesce(tasks), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")).coalesce(tasks), f"{name}-0")
    was = labels.agg(total).first()[0]
    for k in count(1):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(near, "node").select("node", F.least("component", "low").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = scratch.write(lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")).coalesce(tasks), f"{name}-{k}")
        now = labels.agg(total).first()[0]
        if now == was:
            return labels
        was = now


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether both sets hold, from this shingle on, as many shingles as a link of two such sizes takes in common.

    A linked pair passes at its first common shingle, as all its others come later in both sets. So rows that don't pass
    are no loss, and those of sets that merely share a rare shingle, which grow with the square of its holders, end here.
    """
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    return F.least(na - F.col(f"pos_{a}"), nb - F.col(f"pos_{b}")) * (100 + percent) >= (na + nb) * percent


def _pairs(rows: DataFrame) -> DataFrame:
    """Each pair of these rows once."""
    return rows.groupBy("a", "b").agg(F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))


def _room(differ: Column, percent: int) -> Column:
    """Whether sets of n_a and n_b shingles, of which at least `differ` are in one alone, can link; true for null."""
    return F.coalesce(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent), F.lit(True))


def _narrow_allow(percent: int) -> Column:
    """Whether the narrow bitmaps bits_a and bits_b leave room for a link; true where one is missing."""
    flips = [F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(NARROW)]
    return _room(reduce(lambda x, y: x + y, flips), percent)


def _wide_allow(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, n_a, n_b) whose wide bitmaps leave room for a link."""
    for side in "ab":
        pairs = pairs.join(bitmaps.select(F.col("node").alias(side), F.col("wide").alias(f"bits_{side}")), side, "left")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return pairs.where(_room(differ, percent)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    told = scratch.write(_sets(source, words), "sets")
    rows = told.where("n is not null").select("doc_id", "text_hash", "n", "fp1", "fp2")
    top = told.where("n is null").groupBy("shingle").agg(F.sum("met").alias("met")).orderBy(F.col("met").desc(), "shingle").limit(HEAVY).toArrow()
    order = np.lexsort((top.column("shingle").to_numpy(), top.column("met").to_numpy()))
    heavy = top.column("shingle").to_numpy()[order].view(np.uint64)

    known = rows.where("n > 0 and doc_id is not null")
    firsts = known.groupBy("n", "fp1", "fp2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = scratch.write(firsts.select("n", "fp1", "fp2", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("node")), "classes")
    # Rows that repeat a doc_id: of equal ones, one is enough to stand for a node.
    repeats = scratch.write(rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeats")
    repeated = not repeats.isEmpty()
    if repeated:
        source = source.join(repeats, "doc_id", "left_anti").unionByName(source.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return nodes.join(source, (F.col("rep") == F.col("doc_id")) & (F.col("rep_hash") == F.col("text_hash")))

    able = scratch.write(classes.join(_linkable(docs, heavy, percent, words), "fp1", "left_semi"), "able")
    prefixes = scratch.write(_prefixes(_candidates(texts_of(able), heavy, percent, words), percent), "prefixes")
    labels = _joined(prefixes, classes, texts_of, percent, words, scratch)
    scratch.drop("prefixes")
    return _result(rows, classes, labels, repeats if repeated else None, scratch)


def _joined(prefixes: DataFrame, classes: DataFrame, texts_of, percent: int, words: int, scratch: Scratch) -> DataFrame | None:
    """node, component of every node that has a link; None if there is none."""
    # Groups of nodes whose prefixes, of shared shingles alone, are the same.
    told = prefixes.groupBy("node").agg(F.first("n").alias("n"), F.min("pos").alias("start"), *[F.bit_xor(F.xxhash64("shingle", F.lit(k))).alias(f"p{k}") for k in (1, 2)]).where("start = 0")
    groups = told.groupBy("n", "p1", "p2").agg(F.min("node").alias("g"), F.count("*").alias("size")).where("size > 1")
    members = scratch.write(told.join(groups, ["n", "p1", "p2"]).select("g", F.col("node").alias("m")).where("g <> m"), "members")

    # Buckets: prefix shingles that two groups or more have.
    leaders = prefixes.join(members.select(F.col("m").alias("node")), "node", "left_anti").withColumnRenamed("node", "g")
    met = leaders.groupBy("shingle").count().where("count > 1").select("shingle")
    buckets = scratch.write(leaders.join(met, "shingle").select("shingle", "g", "n", "pos"), "buckets")
    nodes = buckets.select(F.col("g").alias("node")).union(members.select("m")).union(members.select("g")).distinct()
    texts = scratch.write(_with_bitmaps(texts_of(classes.join(nodes, "node", "left_semi")), words), "texts")
    if texts.isEmpty():
        return None
    # Bitmaps of groups of one set alone.
    bitmaps = texts.select("node", "bits", "wide").join(members.select(F.col("g").alias("node")), "node", "left_anti")

    # Members of a group against its leader; those that don't link stand in the buckets by themselves.
    tested = scratch.write(members.select(F.col("g").alias("a"), F.col("m").alias("b")), "tested-0")
    labels = None
    if not tested.isEmpty():
        labels, _ = _extended(None, tested, texts, percent, words, scratch, "0")
        linked = scratch.spark.read.schema("a long, b long").parquet(f"{scratch.folder}/links-0")
        apart = scratch.write(tested.join(linked, ["a", "b"], "left_anti").select(F.col("a").alias("g"), "b"), "apart")
        buckets = scratch.write(buckets.unionByName(buckets.join(apart, "g").select("shingle", F.col("b").alias("g"), "n", "pos")), "buckets-0")
        members = members.join(apart.select("g", F.col("b").alias("m")), ["g", "m"], "left_anti")

    for k in range(1, STAR_ROUNDS + 1):
        first = F.col("pos") / F.col("n") if k == 1 else F.lit(0.0)
        held = scratch.write(_labelled(buckets, labels), f"held-{k}")
        hubs = held.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(first.alias("first"), F.xxhash64("g", F.lit(k)).alias("h"), "g", "n", "pos", "c")).alias("hub")).where("lo < hi")
        open_ = held.join(hubs.select("shingle", "hub"), "shingle")
        star = open_.select(F.col("g").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("c").alias("c_b"), *[F.col(f"hub.{x}").alias(y) for x, y in (("g", "a"), ("n", "n_a"), ("pos", "pos_a"), ("c", "c_a"))])
        star = _pairs(star.where((F.col("a") != F.col("b")) & (F.col("c_a") != F.col("c_b")) & _fits("a", "b", percent)))
        star = _wide_allow(star, bitmaps, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = scratch.write(star.join(tested, ["a", "b"], "left_anti"), f"star-{k}")
        buckets = scratch.write(open_.select("shingle", "g", "n", "pos"), f"buckets-{k}")
        scratch.drop(f"held-{k}")
        if fresh.isEmpty():
            break
        tested = tested.unionByName(fresh)
        labels, grew = _extended(labels, fresh, texts, percent, words, scratch, str(k))
        if not grew:
            break

    # All that is left, between components.
    held = scratch.write(_labelled(buckets, labels), "held")
    apart = held.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("shingle")
    mapped = held.join(apart, "shingle", "left_semi").join(bitmaps.select(F.col("node").alias("g"), "bits"), "g", "left")
    one, two = (mapped.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("g", "n", "pos", "c", "bits")]) for s in "ab")
    rest = one.join(two, "shingle").where((F.col("c_a") != F.col("c_b")) & (F.col("g_a") < F.col("g_b")) & _fits("a", "b", percent) & _narrow_allow(percent))
    rest = _wide_allow(_pairs(rest.withColumnsRenamed({"g_a": "a", "g_b": "b"})), bitmaps, percent)
    # Expand groups into members.
    whole = members.select("g", "m").unionByName(members.select("g", F.col("g").alias("m"))).distinct()
    for side in "ab":
        own = whole.select(F.col("g").alias(side), F.col("m").alias("m"))
        rest = rest.join(own, side, "left").select(*[c for c in "ab" if c != side], F.coalesce("m", side).alias(side))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    fresh = scratch.write(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    if not fresh.isEmpty():
        labels, _ = _extended(labels, fresh, texts, percent, words, scratch, "last")
    scratch.drop("texts", "buckets", "held", "members", "tested-0", *[f"{x}-{k}" for x in ("buckets", "star") for k in range(STAR_ROUNDS + 1)])
    return labels


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of buckets with the component of each group (column c)."""
    if labels is None:
        return buckets.select("shingle", "g", "n", "pos", F.col("g").alias("c"))
    return buckets.join(labels, buckets.g == labels.node, "left").select("shingle", "g", "n", "pos", F.coalesce("component", "g").alias("c"))


def _extended(labels: DataFrame | None, fresh: DataFrame, texts: DataFrame, percent: int, words: int, scratch: Scratch, name: str) -> tuple[DataFrame | None, bool]:
    """Components after the fresh pairs are verified, and whether any linked."""
    return _contracted(labels, scratch.write(_linked(fresh, texts, percent, words), f"links-{name}"), scratch, name)


def _contracted(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame | None, bool]:
    """Components with the links (a, b) added, and whether they join any.

    New links are first carried over to the components of their ends, so what is joined round by round is a row for each
    pair of components that meet, not for each link.
    """
    met = links
    if labels is not None:
        for side in "ab":
            own = labels.select(F.col("node").alias(side), F.col("component").alias("c"))
            met = met.join(own, side, "left").select(*[c for c in "ab" if c != side], F.coalesce("c", side).alias(side))
    met = scratch.write(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"met-{name}")
    if not (edges := met.count()):
        return labels, False
    new = components(met, scratch, f"round{name}", 1 + 2 * edges // LABEL_ROWS)
    if labels is None:
        return new, True
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return scratch.write(old.unionByName(new.join(labels.select("node"), "node", "left_anti")), f"labels-{name}"), True


def _result(rows: DataFrame, classes: DataFrame, labels: DataFrame | None, repeats: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Rows with the smallest doc_id of their component. `repeats`: the doc_ids of several rows, if there are any."""
    keys = ["n", "fp1", "fp2"]
    named = lambda of: rows.join(of.withColumnsRenamed({k: f"k_{k}" for k in keys}), [rows[k] == F.col(f"k_{k}") for k in keys], "left")
    if repeats is not None:
        # The sets of one doc_id are linked by it.
        several = scratch.write(named(classes.select(*keys, "node")).join(repeats, "doc_id", "left_semi").where("node is not null").select("doc_id", "node").distinct(), "several")
        least = several.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = scratch.write(several.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "links-ids")
        labels, _ = _contracted(labels, links, scratch, "ids")
    if labels is not None:
        held = classes.join(labels, "node", "left").select(*keys, "rep", F.coalesce("component", "node").alias("c"))
        low = held.groupBy("c").agg(F.min("rep").alias("low"))
        classes = held.join(low, "c").select(*keys, F.col("low").alias("rep"))
    found = named(classes.select(*keys, "rep")).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))
    if repeats is not None:
        # Rows without a set follow those of their doc_id that have one.
        whole = found.where("n_shingles > 0").join(repeats, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("r_id")).agg(F.min("component_id").alias("whole"))
        found = found.join(whole, found.doc_id == whole.r_id, "left").select("doc_id", "n_shingles", F.coalesce("whole", "component_id").alias("component_id"))
    return found


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents without those linked to one of a smaller doc_id, and without repeats of one doc_id and text.

    Here each text of a doc_id is a node of its own, named by a hash, so unlinked texts under one doc_id all stay. Linked
    texts under one doc_id leave one of them. Rows whose doc_id is null link with nothing and all stay.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    known = docs.where("doc_id is not null").select("*", key.alias("_key"))
    found = near_duplicates(known.select(F.col("_key").alias("doc_id"), "text"), percent, words)
    found = found.select(F.col("doc_id").alias("f_key"), "component_id").distinct()
    named = known.select(F.col("_key").alias("f_key"), F.col("doc_id").alias("f_id")).distinct().join(found, "f_key")
    least = named.groupBy("component_id").agg(F.min(F.struct("f_id", "f_key")).alias("least")).select(F.col("least.f_key").alias("kept_key"))
    kept = scratch.write(least, "kept")
    one = known.join(kept, known._key == kept.kept_key, "left_semi").dropDuplicates(["_key", "doc_id", "text"])
    return one.drop("_key").unionByName(docs.where("doc_id is null"))
