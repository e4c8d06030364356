"""Collocations: frequent phrases from vertical inverted lists of word positions, extended by merge joins.

Texts are laid end to end in blocks, those of one group (a language, say) after those of another; a word of two groups
is two words. A block has for each frequent phrase of k words the list of its positions, held as one array over the positions: the phrase that starts there, if any. The list of a phrase
of k + 1 words is the merge join of two such lists, that of its first k words and that of its last k words moved by one:
here, one look at each position and its neighbour for all phrases of the block at once. The lengths of the lists are the
phrase's counts in the block, and their sum over all blocks is its exact frequency. Only phrases that reach `least` are
told back to the blocks and extended, so both parts of every candidate are frequent (a phrase is never more frequent than
a part of it). A block gets back the frequent phrases that it holds, by a join on its number; blocks are tables bucketed
by it, so they stay where they are.

A phrase's key is the pair of its two parts' ids, and ids are gapless numbers of the frequent phrases of one length, so
keys are exact, without hashes. A block sends its lists of two words or more to the parts that count them, as one row a
part: left ids, right ids and lengths in as few bytes as they need. Lists are dealt to parts by their key, with
`PART_WORDS` positions to a part at most on average; a list is one entry in a block whatever its frequency, so a phrase in
every text has as many entries as there are blocks. The part tells each block which of the lists sent are frequent, in the
order they were sent, and their ids: a bit a list, and a number for each frequent one.

A text is lower-cased (A-Z), cut into pieces at `.,;:!?` and the line and form feeds, and pieces into words at spaces and
tabs. Phrases lie within pieces.

Edge cases: a null or empty text has no words; a null group is the group `und`; repeated rows count each time; doc_id and
other columns play no part; an empty table, or one without frequent phrases, gives an empty result. A text longer than a
block is a block of its own.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import Scratch

LEAST, LONGEST, TOP = 30, 4, 2000
#: Share, in percent, of a phrase's occurrences inside one longer phrase that makes it part of that.
INSIDE = 80
#: Bytes of a block's texts.
BLOCK_BYTES = 8 << 20
#: Words of the table to a part that counts lists.
PART_WORDS = 1 << 21
#: Bits of a partition's number, of a block's within it, and of a list's within its block: 63 in all.
PART_BITS, BLOCK_BITS, PLACE_BITS = 22, 10, 31
#: Shares of a group that are ranked apart first.
SALTS = 64
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def packed(codes: np.ndarray) -> bytes:
    """Codes from -1 in few bytes if small ones are common: a byte each, where 254 and 255 stand for two or four bytes behind."""
    up = codes.astype(np.uint32) + np.uint32(1)
    middle, large = (up >= 254) & (up < 65536), up >= 65536
    low = np.where(large, 255, np.where(middle, 254, up)).astype(np.uint8)
    return b"".join([len(low).to_bytes(8, "little"), low.tobytes(), up[middle].astype("<u2").tobytes(), up[large].astype("<u4").tobytes()])


def unpacked(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:8], "little")
    low = np.frombuffer(body, np.uint8, n, 8)
    codes = low.astype(np.int32)
    middle, large = low == 254, low == 255
    at = 8 + n + 2 * int(middle.sum())
    codes[middle] = np.frombuffer(body[8 + n : at], "<u2")
    codes[large] = np.frombuffer(body[at:], "<u4")
    return codes - 1


def _block(texts: list[tuple[str, bytes]]) -> list[pa.Array]:
    """codes, words, grps and counts of one block: the lists of one word, the longest first.

    A position that ends a piece has code -1. Texts are cut one by one, so no more than one text's words are held twice.
    """
    words, grps, codes = [], [], [np.zeros(0, np.int32)]
    for grp in dict.fromkeys(grp for grp, _ in texts):
        code = defaultdict(count(len(words)).__next__, {b"": -2, b"\n": -1})
        for body in (body for own, body in texts if own == grp):
            parts = body.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
            parts.append(b"\n")
            at = np.fromiter(map(code.__getitem__, parts), np.int32, len(parts))
            codes.append(at[at > -2])
        own = list(code)[2:]
        words += own
        grps += [grp] * len(own)
    codes = np.concatenate(codes)
    counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
    order, codes = by_length(codes, len(words))
    words, grps = [words[k] for k in order.tolist()], [grps[k] for k in order.tolist()]
    return [pa.array([packed(codes)], pa.binary()), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([grps], pa.list_(pa.string())), pa.array([counts[order]], pa.list_(pa.int64()))]


def by_length(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n lists from the longest, and the codes renumbered so."""
    order = np.argsort(-np.bincount(codes[codes >= 0], minlength=n), kind="stable")
    place = np.full(n + 1, -1, np.int32)
    place[order] = np.arange(n)
    return order, place[codes]


def _blocks(docs: DataFrame) -> DataFrame:
    """block, codes, words, grps, counts."""
    names = ["block", "codes", "words", "grps", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size = TaskContext.get().partitionId(), 0, 0
        texts: list[tuple[str, bytes]] = []

        def block() -> pa.RecordBatch:
            nonlocal made, size, texts
            if part >> PART_BITS or made >> BLOCK_BITS:
                raise ValueError("more partitions, or more blocks in one, than block numbers")
            number, made, size = part << BLOCK_BITS | made, made + 1, 0
            arrays, texts = _block(texts), []
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays], names)

        for batch in batches:
            for grp, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                body = text.as_py() or b""
                if size and size + len(body) > BLOCK_BYTES:
                    yield block()
                texts.append((grp, body))
                size += len(body) + 1
        if texts:
            yield block()

    return docs.mapInArrow(run, "block long, codes binary, words array<string>, grps array<string>, counts array<long>")


def planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0, each in as many bytes as the largest needs, first all low bytes: high ones compress well."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(body: bytes) -> np.ndarray:
    width, n = body[0], (len(body) - 1) // body[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, offset=1).reshape(width, n).T
    return out.view("<i8").ravel()


def neighbours(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a position and the next both have one of n lists, and for those that do the pair as one number."""
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    pairs = codes[:-1][both].astype(np.int64)
    pairs *= max(n, 1)
    pairs += codes[1:][both]
    return both, pairs


def dealt(pairs: np.ndarray, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left and right ids of distinct pairs, their order by part, and where each part starts in it.

    A part is a function of the two ids, so all blocks count a pair in one part, and a block finds its pairs again.
    """
    n = max(len(ids), 1)
    left, right = ids[pairs // n], ids[pairs % n]
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    part = (mixed % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    return left, right, np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _lists(blocks: DataFrame, parts: int) -> DataFrame:
    """The lists that two neighbours make: block, part, heads, sizes, tails, counts; a row for each part of a block.

    heads: left ids in runs of sizes; tails and counts: the right id and the length of each list.
    """
    names = ["block", "part", "heads", "sizes", "tails", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = numbers(batch.column(2)[k].as_py())
                new, counts = np.unique(neighbours(unpacked(batch.column(1)[k].as_py()), len(ids))[1], return_counts=True)
                left, right, order, starts = dealt(new, ids, parts)
                some, rows = np.flatnonzero(np.diff(starts)), []
                for part in some.tolist():
                    own = order[starts[part] : starts[part + 1]]
                    runs = np.flatnonzero(np.concatenate([[True], np.diff(left[own]) != 0]))
                    rows.append((planes(left[own][runs]), planes(np.diff(np.append(runs, len(own)))), planes(right[own]), planes(counts[own])))
                if rows:
                    columns = [pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(rows), pa.int64()), pa.array(some, pa.int32()), *columns], names)

    return blocks.select("block", "codes", "ids").mapInArrow(run, "block long, part int, heads binary, sizes binary, tails binary, counts binary")


def _counted(lists: DataFrame, least: int) -> DataFrame:
    """Of each part, what its blocks are told, and the frequent phrases.

    The former has block, mask (which of the block's lists in the part are frequent, in the order sent) and ranks (of
    those); the latter left, right, f and rank (their place in the part).
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("mask", pa.binary()), ("ranks", pa.binary()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64()), ("rank", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        body = {c: [numbers(x.as_py()) for x in table.column(c)] for c in ("heads", "sizes", "tails", "counts")}
        ends = np.cumsum([len(x) for x in body["tails"]])
        left, right = np.repeat(np.concatenate(body["heads"]), np.concatenate(body["sizes"])), np.concatenate(body["tails"])
        span = int(right.max()) + 1
        if int(left.max()) < (1 << 63) // span - 1:
            pairs = left * span + right
        else:  # too large for one number: by place among the part's own ids
            rights, at = np.unique(right, return_inverse=True)
            pairs = np.unique(left, return_inverse=True)[1] * len(rights) + at
        _, first, which = np.unique(pairs, return_index=True, return_inverse=True)
        # Sums in doubles are exact below 2^53.
        f = np.bincount(which, np.concatenate(body["counts"])).astype(np.int64)
        kept = np.flatnonzero(f >= least)
        rank = np.full(len(f), -1, np.int64)
        rank[kept] = np.arange(len(kept))
        blocks, masks, ranks = [], [], []
        for block, own in zip(table.column("block").to_pylist(), np.split(rank[which], ends[:-1]), strict=True):
            if (own >= 0).any():
                blocks.append(block)
                masks.append(np.packbits(own >= 0).tobytes())
                ranks.append(planes(own[own >= 0]))
        m, n, part = len(blocks), len(kept), table.column("part")[0].as_py()
        none = lambda size, kind: pa.nulls(size, kind)
        at = first[kept]
        told = [pa.array([part] * m, pa.int32()), pa.array(blocks, pa.int64()), pa.array(masks, pa.binary()), pa.array(ranks, pa.binary()), *[none(m, pa.int64())] * 4]
        found = [pa.array([part] * n, pa.int32()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary()), pa.array(left[at]), pa.array(right[at]), pa.array(f[kept]), pa.array(rank[kept])]
        return pa.concat_tables([pa.Table.from_arrays(told, schema=schema), pa.Table.from_arrays(found, schema=schema)])

    return lists.groupBy("part").applyInArrow(run, "part int, block long, mask binary, ranks binary, left long, right long, f long, rank long")


def _next(blocks: DataFrame, told: DataFrame, starts: np.ndarray, parts: int) -> DataFrame:
    """Blocks with the frequent ones of their lists, the longest first: block, codes, ids.

    `blocks`: block, codes and, but for lists of one word, ids, as lists are numbered by neighbours of the codes then;
    `told`: block, places; `starts`: the first id of each part.
    """
    names = ["block", "codes", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, places = unpacked(batch.column(1)[k].as_py()), batch.column(3)[k].values
                part = places.field("part").to_numpy()
                if batch.column(2)[k].is_valid:
                    ids = numbers(batch.column(2)[k].as_py())
                    both, pairs = neighbours(codes, len(ids))
                    new, which = np.unique(pairs, return_inverse=True)
                    codes = np.full(len(both), -1, np.int32)
                    codes[both] = which
                    _, _, order, at = dealt(new, ids, parts)
                    ranks = [numbers(x.as_py()) for x in places.field("ranks")]
                    own = [order[at[p] : at[p + 1]] for p in part.tolist()]
                    kept = np.concatenate([x[np.unpackbits(np.frombuffer(mask.as_py(), np.uint8), count=len(x)) > 0] for x, mask in zip(own, places.field("mask"), strict=True)])
                    ids = np.repeat(starts[part], [len(x) for x in ranks]) + np.concatenate(ranks)
                else:
                    kept, ids = places.field("at").to_numpy(), starts[part] + places.field("rank").to_numpy()
                code = np.full(max(int(codes.max(initial=-1)), int(kept.max(initial=-1))) + 2, -1, np.int32)
                code[kept] = np.arange(len(kept))
                longest, now = by_length(code[codes], len(kept))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([packed(now)], pa.binary()), pa.array([planes(ids[longest])], pa.binary())], names)

    ids = "ids" if "ids" in blocks.columns else F.lit(None).cast("binary").alias("ids")
    joined = blocks.join(told, "block").select("block", "codes", ids, "places")
    return joined.mapInArrow(run, "block long, codes binary, ids binary")


def _frequent_words(lists: DataFrame, least: int, parts: int) -> DataFrame:
    """Of lists of one word: part, place and rank, and once a word grp, word and f, for those frequent; one shuffle."""
    each, w = ["part", "grp", "word"], Window.partitionBy("part", "grp", "word")
    some = lists.select(F.pmod(F.xxhash64("grp", "word"), F.lit(parts)).cast("int").alias("part"), "grp", "word", "place", "count").repartition(parts, "part")
    some = some.select(*each, "place", F.min("place").over(w).alias("first"), F.sum("count").over(w).alias("f")).where(F.col("f") >= least)
    rank = (F.dense_rank().over(Window.partitionBy("part").orderBy("grp", "word")) - 1).cast("long").alias("rank")
    return some.select("*", rank).select("part", "place", "rank", *[F.when(F.col("place") == F.col("first"), F.col(c)).alias(c) for c in ("grp", "word", "f")])


def _starts(found: DataFrame, parts: int) -> tuple[np.ndarray, DataFrame]:
    """The first id of each part, as an array and as a table: ids are gapless. One number a part comes to the driver."""
    sizes = np.zeros(parts + 1, np.int64)
    for part, n in found.groupBy("part").agg(F.max("rank") + 1).where("part is not null").collect():
        sizes[part + 1] = n or 0
    starts = np.cumsum(sizes)[:-1]
    return starts, found.sparkSession.createDataFrame(list(enumerate(starts.tolist())), "part int, start long")


class _Blocks:
    """Tables of blocks in the scratch folder, bucketed by block, so that what blocks are told is joined without moving them."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets, self.prefix = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"lists_{uuid.uuid4().hex}"

    def write(self, df: DataFrame, k: int) -> DataFrame:
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.scratch.folder}/blocks-{k}").saveAsTable(f"{self.prefix}_{k}")
        return self.spark.table(f"{self.prefix}_{k}")

    def drop(self, k: int) -> None:
        self.spark.sql(f"DROP TABLE {self.prefix}_{k}")
        self.scratch.drop(f"blocks-{k}")


def phrases(docs: DataFrame, group: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): grp, id, parts (left, right), phrase, length, f, heads and tails of every frequent phrase, and
    grp, n: the words of each group. heads[k - 1] is the frequency of the first k words, tails[k - 1] of the last k."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(group), F.lit("und")).alias("grp"), "text")
    tables = _Blocks(scratch)
    blocks = tables.write(_blocks(rows), 1)
    each = blocks.select("block", F.posexplode("words").alias("at", "word"), "grps", "counts")
    place = F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("at").cast("long")).alias("place")
    lists = each.select(F.get("grps", "at").alias("grp"), "word", place, F.get("counts", "at").alias("count"))
    totals = scratch.write(lists.groupBy("grp").agg(F.sum("count").alias("n")), "totals")
    parts = tables.buckets
    found = scratch.write(_frequent_words(lists, least, parts), "found-1")
    starts, table = _starts(found, parts)
    at = F.struct("part", "rank", F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("at"))
    told = found.groupBy(F.shiftright("place", PLACE_BITS).alias("block")).agg(F.collect_list(at).alias("places"))
    none, id_ = F.expr("cast(array() as array<bigint>)"), (F.col("start") + F.col("rank")).alias("id")
    own = found.where("f is not null").join(F.broadcast(table), "part")
    level = own.select("grp", id_, F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(1).alias("length"), "f", none.alias("heads"), none.alias("tails"))
    level = scratch.write(level, "level-1")
    levels = [level]
    total = totals.agg(F.sum("n")).first()[0] or 0
    for k in range(2, longest + 1):
        blocks = tables.write(_next(blocks.select("block", "codes", *(["ids"] if k > 2 else [])), told, starts, parts), k)
        tables.drop(k - 1)
        scratch.drop(f"found-{k - 1}")
        parts = max(tables.buckets, int(total) // PART_WORDS)
        found = scratch.write(_counted(_lists(blocks, parts), least), f"found-{k}")
        starts, table = _starts(found, parts)
        told = found.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "mask", "ranks")).alias("places"))
        a = level.select("grp", F.col("id").alias("left"), F.col("phrase").alias("l_phrase"), F.array_append("heads", F.col("f")).alias("heads"))
        b = level.select(F.col("id").alias("right"), "last", F.array_append("tails", F.col("f")).alias("tails"))
        own = found.where("f is not null").join(F.broadcast(table), "part").select(id_, "left", "right", "f").join(a, "left").join(b, "right")
        level = own.select("grp", "id", "left", "right", F.concat_ws(" ", "l_phrase", "last").alias("phrase"), "last", F.lit(k).alias("length"), "f", "heads", "tails")
        level = scratch.write(level, f"level-{k}")
        levels.append(level)
    tables.drop(longest)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def collocations(docs: DataFrame, group: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The group, rank, phrase, a, l, r, n, score: each group's `top` phrases of two words or more.

    a is the phrase's frequency, l and r those of its two parts at the cut that scores lowest (ties: the first), n the
    words of the group and score floor(2000000 a / (l + r)). Phrases of which `inside` percent or more lie in one longer
    frequent phrase are dropped; it is enough to look at those longer by one word, as these are no less frequent.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    known, totals = phrases(docs, group, least, longest)
    within = known.where("length > 2").select((F.col("length") - 1).alias("length"), F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("length", "id").agg(F.max("f").alias("longer"))
    floor = lambda l, r: F.expr(f"cast((cast(2000000 as decimal(38,0)) * f) div (cast({l} as decimal(38,0)) + {r}) as bigint)")  # noqa: E731,E741
    cuts = F.array_compact(F.array(*[F.when(F.col("length") > k, F.struct(floor(f"get(heads, {k - 1})", f"get(tails, length - {k} - 1)").alias("score"), F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.col("length") - k - 1).alias("r"))) for k in range(1, longest)]))
    rows = known.where("length > 1").join(within, ["length", "id"], "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("f")) * inside))
    rows = rows.select("grp", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut")).select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within shares of a group, then among what these leave.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("share")
    rows = rows.select("*", share).select("*", F.row_number().over(Window.partitionBy("grp", "share").orderBy(*best)).alias("rank")).where(F.col("rank") <= top).drop("share", "rank")
    rows = rows.select("*", F.row_number().over(Window.partitionBy("grp").orderBy(*best)).alias("rank")).where(F.col("rank") <= top)
    return rows.join(totals, "grp").select(F.col("grp").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
