"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the mix has the point frac(i / golden ratio); the cumulative target shares map that point to a source.
A source's slots are ranked, and rank r takes its block r modulo its number of blocks: the source's documents, laid
end to end in a hash-shuffled order, are cut into blocks of equal tokens. Successive slots of all sources thus
interleave evenly, and every prefix of the mix is near the target weights.

Edge cases: a null source is a source of its own, last in order; null and empty texts have size 0 and take
nothing; repeated rows are laid out one after the other and each takes its own words; an empty table gives an empty
result. No document is taken more than `max_epochs` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import Scratch, blocked_prefix_sum, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Tokens of a block: a 2**14th part of the mix, and at most 4096.
BLOCK_TOKENS, BLOCK_SHARE_BITS = 4096, 14
#: Blocks of rows in which a source's prefix sums run, and slots that are ranked together.
SHUFFLE_BLOCKS, SLOT_RUN = 4096, 65536
#: Cells of the unit interval by which points find their source.
CELLS = 1024
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target. Water-filling: what a capped source can't take is reshared by weight.

    With sources in ascending order of cap / weight, each source's level is what a unit of weight gets if all before it
    are capped. That level rises as long as sources are rightly capped and falls afterwards, so its maximum is the answer.
    The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("*", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).alias("weight"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    per = per.select("*", (F.col("source_size") * float(max_epochs)).alias("cap"))
    by = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before, after = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*by).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.select("*", level.alias("level"))
    water = F.max("level").over(Window.partitionBy())
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(water, F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(spark, targets: DataFrame, block_tokens: int, slots: int) -> DataFrame:
    """The mix's slots: slot, source, rank (from 0, by slot). Points meet sources in cells, so many sources are no range scan."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy())
    arcs = targets.where("target > 0").select("source", (F.coalesce(F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total).alias("lo"), (F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("hi"), F.lead("source", 1).over(w).isNull().alias("no_next"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    arcs = arcs.select("source", "lo", F.when(F.col("k") == F.col("n"), 2.0).otherwise(F.col("hi")).alias("hi"))
    arcs = arcs.select("*", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))).alias("cell"))
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    points = points.select("*", F.floor(F.col("point") * CELLS).alias("cell"), F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    hit = points.join(arcs, "cell").where("point >= lo and point < hi").select("slot", "run", "source")
    return blocked_prefix_sum(hit, ["source"], "run", [F.col("slot")], {"rank": F.lit(1)})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, size: Column | None = None, block_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken (tokens the mix takes, repeats counted)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"))
    scratch = Scratch(spark)
    rows = scratch.write(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")
    targets = source_targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, max_epochs)
    targets = scratch.write(targets, "targets")
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    block = block_tokens or max(1, min(BLOCK_TOKENS, total >> BLOCK_SHARE_BITS))
    slots = -(-total // block)
    shuffled = F.xxhash64(F.lit(seed), "doc_id", "size")
    laid = rows.select("*", shuffled.alias("at"), F.floor(F.shiftrightunsigned(shuffled, 40) / (2**24 // SHUFFLE_BLOCKS)).alias("part"))
    order = [F.shiftrightunsigned("at", 1).asc(), F.col("at").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc()]
    laid = blocked_prefix_sum(laid, ["source"], "part", order, {"start": F.col("size") * F.col("copies")})
    laid = laid.select("doc_id", "source", "size", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    laid = laid.select("doc_id", "source", "size", "copy", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))
    # A block is taken as often as the schedule has ranks that fall on it, at most max_epochs times.
    ranks = schedule(spark, targets, block, slots).join(targets.select(F.col("source").alias("s"), F.ceil(F.col("source_size") / block).alias("blocks")), F.col("source").eqNullSafe(F.col("s")))
    ranks = ranks.where(F.col("rank") < F.col("blocks") * max_epochs)
    times = ranks.groupBy("source", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    pieces = laid.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("piece"))
    pieces = pieces.select("doc_id", "source", "size", "copy", "piece", (F.least((F.col("piece") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("piece") * block, F.col("start"))).alias("tokens"))
    t = times.select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), "times")
    met = pieces.join(t, (pieces.piece == t.t_block) & pieces.source.eqNullSafe(t.t_source))
    taken = met.groupBy("doc_id", "source", "size", "copy").agg(F.sum(F.col("tokens") * F.col("times")).alias("taken"))
    taken = taken.select(*[F.col(c).alias(f"k_{c}") for c in ("doc_id", "source", "size", "copy")], "taken")
    out = laid.join(taken, [laid[c].eqNullSafe(taken[f"k_{c}"]) for c in ("doc_id", "source", "size", "copy")], "left")
    out = out.select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    per = targets.select(F.col("source").alias("p_source"), "source_size", "target")
    return out.join(per, out.source.eqNullSafe(per.p_source)).select("doc_id", "size", "source", "source_size", "target", "taken")
