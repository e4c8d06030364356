"""Near-duplicate groups of documents: SuperMinHash signatures, banding, verification on full sets, components.

A signature has `registers` values. Every shingle of a set has a pseudo-random permutation of the registers and a random
fraction a rank; at rank j it offers j + fraction to the register its permutation names there, and a register keeps the
least offer. So of one shingle no two ranks meet in a register, which makes the estimate's variance less than that of
independent hash functions. Offers of rank j are never below those of a rank before: ranks are taken one after the other
for all shingles of a run of texts, and a set stops once its registers are all filled. Sets of a thousand shingles need
about one rank, single shingles all.

Signatures are cut into bands of `rows` registers. Sets that agree in a band share a bucket. Two sets of similarity s
miss each other in all bands with probability (1 - s**rows)**bands or less: at 0.85, 5 rows and 26 bands, 2.4e-7.
Distinct sets are the nodes, so copies never meet pair by pair, and sets with the same buckets stand in the join once. The
buckets then go the way of the set-similarity join (`jaccard`): star rounds about hubs, the rest pair by pair behind size
and bitmap bounds; each link is confirmed on whole shingle sets, and a bucket has no cap. Union-find is its distributed
form: labels hook to the least neighbour and jump to their label's label.

Edge cases: a document without words or text has no shingles, links with nothing, is its own component and kept; texts
of fewer words than a shingle are one shingle; rows of one doc_id are one document, linked by any of its texts, and each
row tells its own text's number of shingles; a null doc_id has no component, links with nothing and is kept; an empty
table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm import jaccard
from fieldweave.llm.common import Scratch
from fieldweave.llm.shingles import mixed, shingle_sets
from fieldweave.llm.textblocks import blocks

PERCENT, WORDS = 85, 3
ROWS, BANDS = 5, 26
_STEP = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def signatures(flat: np.ndarray, sizes: np.ndarray, registers: int) -> np.ndarray:
    """A row of registers for each set; `flat` has the shingles of all sets one after the other. At most 256 registers.

    A value is the rank, above 32 bits, and the fraction. Empty sets keep the greatest value in all registers.
    """
    held = np.full((len(sizes), registers), _EMPTY)
    offers, owner, item = held.reshape(-1), np.repeat(np.arange(len(sizes)), sizes), flat
    order = None  # each item's permutation, as far as its swaps go
    for rank in range(registers):
        with np.errstate(over="ignore"):
            x = mixed(item + np.uint64((rank + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((x >> _HALF) * np.uint64(registers - rank) >> _HALF).astype(np.int64)
        rows = np.arange(len(item))
        place = pick if order is None else order[rows, pick].astype(np.int64)
        np.minimum.at(offers, owner * registers + place, (np.uint64(rank) << _HALF) | (x & _LOW))
        open_ = (held == _EMPTY).any(axis=1)[owner]
        if not open_.any():
            break
        if order is None:
            order = np.tile(np.arange(registers, dtype=np.uint8), (int(open_.sum()), 1))
        else:
            order[rows, pick] = order[:, rank]
            order = order[open_]
        item, owner, pick = item[open_], owner[open_], pick[open_]
        if rank == 0:
            order[np.arange(len(item)), pick] = 0
    return held


def band_keys(held: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` registers: a row of keys for each set. The band's number is in the key."""
    sets, registers = held.shape
    bands = registers // rows
    parts = held[:, : bands * rows].reshape(sets, bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP)), (sets, bands)).copy()
        for k in range(rows):
            key = mixed(key + parts[:, :, k])
    return key


def _signed(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """Per row: doc_id, text_hash, size and two hashes of its set, and the keys of its bands."""
    names = ["doc_id", "text_hash", "n", "fp1", "fp2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, offsets in blocks(batch.column(2)):
                flat, _, sizes, fp1, fp2 = jaccard._fingerprints(shingle_sets(body, offsets, words))
                keys = band_keys(signatures(flat, sizes, rows * bands), rows).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], pa.array(sizes), pa.array(fp1), pa.array(fp2), lists], names)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n long, fp1 long, fp2 long, bands array<long>")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    told = scratch.write(_signed(source, words, rows, bands), "signed")
    known = told.where("n > 0 and doc_id is not null")
    firsts = known.groupBy("n", "fp1", "fp2").agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("first"))
    classes = firsts.select("n", "fp1", "fp2", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), F.col("first.bands").alias("bands"), F.monotonically_increasing_id().alias("node"))
    classes = scratch.write(classes, "classes")
    # Rows that repeat a doc_id: of equal ones, one is enough to stand for a node.
    repeats = scratch.write(told.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeats")
    repeated = not repeats.isEmpty()
    if repeated:
        source = source.join(repeats, "doc_id", "left_anti").unionByName(source.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return nodes.drop("bands").join(source, (F.col("rep") == F.col("doc_id")) & (F.col("rep_hash") == F.col("text_hash")))

    each = classes.select("node", "n", F.explode("bands").alias("shingle"))
    met = each.select("*", F.count("*").over(Window.partitionBy("shingle")).alias("nodes")).where("nodes > 1")
    buckets = scratch.write(met.select("node", "n", F.lit(0).cast("long").alias("pos"), "shingle"), "met")
    labels = jaccard._joined(buckets, classes.drop("bands"), texts_of, percent, words, scratch)
    found = jaccard._result(told.select("doc_id", "text_hash", "n", "fp1", "fp2"), classes.drop("bands"), labels, repeats if repeated else None, scratch)
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
