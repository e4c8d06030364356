"""First visits of a depth-first walk with one visited set per root, found breadth-wise.

A depth-first walk meets a node first along the path of least step ordinals. So each node keeps the least path known and
passes it on whenever it improves; when nothing improves, the paths are the walk's. Pruning on first arrival would not do.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.scratch import Scratch


def first_visits(roots: DataFrame, edges: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """root, keys, path: every node a root reaches, with its least path (array of ordinals; empty for the root's own node).

    `roots`: root and keys; `edges`: keys, next_<key> for each, ord.
    """
    empty = F.expr("cast(array() as array<bigint>)")
    best = scratch.write(roots.select("root", *keys, empty.alias("path")), f"{name}0")
    front = best
    for k in count(1):
        met = front.join(edges, keys).select("root", *[F.col(f"next_{c}").alias(c) for c in keys], F.array_append("path", F.col("ord").cast("long")).alias("path"))
        met = met.groupBy("root", *keys).agg(F.min("path").alias("path"))
        known = best.select("root", *keys, F.col("path").alias("old"))
        front = scratch.write(met.join(known, ["root", *keys], "left").where("old is null or path < old").select("root", *keys, "path"), f"{name}-front{k}")
        if front.isEmpty():
            return best
        best = scratch.write(best.join(front.select("root", *keys), ["root", *keys], "left_anti").unionByName(front), f"{name}{k}")
