"""Sharding by jump consistent hashing, in SQL functions only.

The jump hash of Lamping and Veach walks a key's own pseudo-random jumps and needs no ring table: growing from
n to n + 1 shards moves a key only into the new shard, and 1/(n + 1) of the keys do move.

Edge cases: a null key has one fixed hash and so one shard; null text has size 1 and crc32 0; repeated rows stay
repeated and get slots of their own; an empty table gives an empty manifest. Other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import blocked_prefix_sum

#: The multiplier of the jump hash's linear congruential generator, as published.
JUMP_MULTIPLIER = 2862933555777941757
#: Blocks in which the slots of a shard are numbered.
SLOT_BLOCKS = 1024


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among `shards`. The generator's state is an unsigned decimal(20), so nothing overflows."""
    word = F.lit(str(2**64)).cast("decimal(20,0)")
    state = key.cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), F.when(key < 0, (state + word).cast("decimal(20,0)")).otherwise(state).alias("k"))

    def jump(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(JUMP_MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")).cast("decimal(38,0)") % word).cast("decimal(20,0)")
        high = F.floor(k / F.lit(2**33).cast("decimal(11,0)")).cast("double")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / (high + 1.0))).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), j.alias("j"), k.alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["b"].cast("int"))


def shard_manifest(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless slot and checksum of every document, and its shard after one more is appended.

    Rows equal in key, size and checksum are counted before the shuffle and spread again after numbering.
    """
    rows = docs.select(F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    hashed = F.xxhash64("doc_id")
    placed = counted.select("*", jump_hash(hashed, shards).alias("shard"), jump_hash(hashed, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_BLOCKS)).alias("block"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32")]
    first = blocked_prefix_sum(placed, ["shard"], "block", order, {"first_slot": F.col("copies")})
    slots = first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first_slot") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
