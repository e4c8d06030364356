"""Exact top-k search by inner product: a ball tree per shard, searched branch and bound.

Vectors are dealt into cells by the nearest of a bounded sample of them (the pivots), and large cells by hash into shards.
A shard's task builds one ball tree over its vectors and streams the queries that come to it past that tree, block by
block. A node with centre c and radius r bounds any inner product with q by <q, c> + |q| r; a query goes down the tree,
the child of the higher bound first, and leaves out every node whose bound is below its current k-th score. Queries of
a block move together, so the scores of a leaf are one matrix product.

The k-th score is shared: each query first searches one shard of the cell of its highest product with the pivots, and its
k-th score there goes with it to the others. Cells whose own ball, about their pivot, has a bound below it are left out
before anything is shuffled.

Bounds are widened by a relative `SLACK` for rounding. Scores are exact while products stay below 2**53; larger ones
can't be told apart in double arithmetic, so they raise.

Edge cases: a null vector, and one with a null or non-finite component, or of another length than the query, takes no
part; fewer than k candidates give all; ties go to the smaller id; repeated rows of an id are all candidates of other
ids; a query's own row is not its candidate. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import Scratch

LEAF_ROWS = 256
#: Rows of a shard; pivots at most; queries that move together.
SHARD_ROWS, PIVOTS, QUERY_ROWS = 16_384, 256, 1024
SLACK = 1e-9


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double, in double arithmetic; null if a component is null or not finite."""
    doubles = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, doubles)


class BallTree:
    """Nodes in preorder: centre, radius, children (or the rows of a leaf). A node splits at the median along the
    direction between two far points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.ids = points, ids
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            x, node = points[rows], len(self.radii)
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            centre = x.mean(axis=0)
            away = ((x - centre) ** 2).sum(axis=1)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(away.max())))
            split = len(rows) > leaf_rows and away.max() > 0
            self.children.append((-1, -1) if split else None)
            self.rows.append(None if split else rows)
            if split:
                far = x[np.argmax(away)]
                other = x[np.argmax(((x - far) ** 2).sum(axis=1))]
                order, half = np.argsort(x @ (other - far), kind="stable"), len(rows) // 2
                todo += [(rows[order[:half]], node, 0), (rows[order[half:]], node, 1)]

    def bound(self, node: int, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return upper(queries, lengths, self.centres[node], self.radii[node])

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's k best rows at `kth` (the score known so far) or above; -inf where there are fewer."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        best = np.full((len(queries), k), -np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)
        kth = kth.copy()
        todo = [(0, np.arange(len(queries)), self.bound(0, queries, lengths))]
        while todo:
            node, q, bound = todo.pop()
            q = q[bound >= kth[q]]
            if not len(q):
                continue
            if self.children[node] is None:
                self._leaf(node, q, queries, own, best, who, kth)
                continue
            left, right = self.children[node]
            one, two = (self.bound(c, queries[q], lengths[q]) for c in (left, right))
            # Each half of the queries takes the child of its higher bound first.
            for first, mask in ((True, one >= two), (False, one < two)):
                near, far = (left, right) if first else (right, left)
                b_near, b_far = (one, two) if first else (two, one)
                if mask.any():
                    todo += [(far, q[mask], b_far[mask]), (near, q[mask], b_near[mask])]
        return best, who

    def _leaf(self, node: int, q: np.ndarray, queries: np.ndarray, own: np.ndarray, best: np.ndarray, who: np.ndarray, kth: np.ndarray) -> None:
        rows = self.rows[node]
        score = queries[q] @ self.points[rows].T
        if np.abs(score).max(initial=0) >= 2.0**53:
            raise ValueError("inner products of 2**53 and above are not exact")
        there = np.broadcast_to(self.ids[rows], score.shape)
        score = np.where(there == own[q][:, None], -np.inf, score)
        better = (score >= kth[q][:, None]).any(axis=1)
        q, score, there = q[better], score[better], there[better]
        both, names = np.concatenate([best[q], score], axis=1), np.concatenate([who[q], there], axis=1)
        top = np.lexsort((names, -both), axis=1)[:, : best.shape[1]]
        best[q], who[q] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        kth[q] = np.maximum(kth[q], best[q, -1])


def upper(queries: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: float | np.ndarray) -> np.ndarray:
    """No inner product of a query with a point of the ball is above this; `centre` may be one or several."""
    product = queries @ centre.T
    reach = lengths[:, None] * (radius + SLACK * np.sqrt((centre**2).sum(axis=1)))[None, :] if centre.ndim == 2 else lengths * (radius + SLACK * np.sqrt((centre**2).sum()))
    return product + reach * (1 + SLACK) + SLACK


def _cells(pivots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and its distance, widened for rounding."""
    cell = np.argmin((pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T, axis=1)
    return cell, np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1)) * (1 + SLACK)


def _dealer(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                cell, away = np.full(len(part), -1), np.zeros(len(part))
                rows = np.stack(part["vector"].to_numpy()) if dim else np.zeros((len(part), 0))
                if dim in pivots:
                    cell, away = _cells(pivots[dim], rows)
                else:  # no pivot of this length: one cell about the origin
                    away = np.sqrt((rows**2).sum(axis=1)) * (1 + SLACK)
                yield part.assign(cell=cell, away=away)

    return run


def _chooser(pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float], first: bool):
    """Emits each query once for its best cell (`first`), or for all cells that may hold a score of kth or above."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                cells = np.array(sorted(c for d, c in radii if d == dim), int)
                if not len(cells):
                    continue
                rows = np.stack(part["vector"].to_numpy()) if dim else np.zeros((len(part), 0))
                centres = pivots[dim][cells] if dim in pivots else np.zeros((1, rows.shape[1]))
                if first:
                    q, at = np.arange(len(part)), np.argmax(rows @ centres.T, axis=1)
                else:
                    bound = upper(rows, np.sqrt((rows**2).sum(axis=1)), centres, np.array([radii[dim, c] for c in cells.tolist()]))
                    q, at = np.nonzero(bound >= part["kth"].to_numpy()[:, None])
                yield part.iloc[q].assign(cell=cells[at])

    return run


def _searcher(k: int, query_rows: int):
    """Rows come sorted by shard, candidates before queries: a shard's tree is built once and its queries stream past it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, held = None, None, []
        for batch in batches:
            for now, part in batch.groupby(["dim", "cell", "shard"], sort=True):
                if now != key:
                    key, tree, held = now, None, []
                points = part[~part["asks"]]
                if len(points):
                    held.append((np.stack(points["vector"].to_numpy()), points["vec_id"].to_numpy()))
                queries = part[part["asks"]]
                if not len(queries) or not (held or tree):
                    continue
                if tree is None:
                    tree, held = BallTree(np.concatenate([x for x, _ in held]), np.concatenate([i for _, i in held])), []
                for at in range(0, len(queries), query_rows):
                    some = queries.iloc[at : at + query_rows]
                    own = some["vec_id"].to_numpy()
                    best, who = tree.search(np.stack(some["vector"].to_numpy()), own, some["kth"].to_numpy(), k)
                    q, place = np.nonzero(np.isfinite(best))
                    yield pd.DataFrame({"query_id": own[q], "vec_id": who[q, place], "score": best[q, place].astype("int64")})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vector: Column | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Each query's k highest inner products: query_id, rank (from 1), vec_id, score.

    Candidates go in shards of about `shard_rows`, each shuffled once a pass; queries go only to shards that may better
    their k-th score. Of the k rows a query and shard, each task keeps k a query before the window that ranks them.
    """
    made = vectors.select("vec_id", (quantised(F.col("embedding")) if vector is None else vector).alias("vector")).where("vector is not null and vec_id is not null")
    scratch = Scratch(vectors.sparkSession)
    made = scratch.write(made.select("*", is_query.alias("is_query"), F.size("vector").alias("dim")), "vectors")
    wanted = max(1, min(pivots, -(-made.count() // shard_rows)))
    sample: dict[int, list] = {}
    for row in made.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(wanted).collect():
        sample.setdefault(row["dim"], []).append(row["vector"])
    centres = {d: np.array(x) for d, x in sample.items()}
    dealt = scratch.write(made.mapInPandas(_dealer(centres), "vec_id long, vector array<double>, is_query boolean, dim int, cell int, away double"), "dealt")
    # One row a cell: at most `pivots` and one for each length of vector without a pivot.
    told = dealt.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
    radii = {(r["dim"], r["cell"]): r["radius"] for r in told}
    cells = F.broadcast(vectors.sparkSession.createDataFrame([(r["dim"], r["cell"], max(1, -(-r["n"] // shard_rows))) for r in told], "dim int, cell int, shards int"))
    base = dealt.join(cells, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector", F.lit(0.0).alias("kth"))
    queries = made.where("is_query").dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector", "dim")
    none = F.lit(float("-inf"))
    shape = "vec_id long, vector array<double>, dim int, kth double, cell int"

    def passed(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        rows = candidates.unionByName(asked.select("dim", "cell", "shard", F.lit(True).alias("asks"), "vec_id", "vector", "kth"))
        rows = rows.repartition("dim", "cell", "shard").sortWithinPartitions("dim", "cell", "shard", "asks")
        return rows.mapInPandas(_searcher(k, query_rows), "query_id long, vec_id long, score long")

    first = scratch.write(queries.withColumn("kth", none).mapInPandas(_chooser(centres, radii, True), shape), "first")
    seed = scratch.write(passed(base.where("shard = 0"), first.withColumn("shard", F.lit(0))), "seed")
    known = seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).where(F.col("n") >= k)
    # A query id with several vectors has no common k-th score.
    single = queries.groupBy("vec_id").count().where("count = 1").select(F.col("vec_id").alias("query_id"))
    known = known.join(single, "query_id").select(F.col("query_id").alias("k_id"), "low")
    asked = queries.join(known, queries.vec_id == known.k_id, "left").select("vec_id", "vector", "dim", F.coalesce("low", none).alias("kth"))
    pairs = asked.mapInPandas(_chooser(centres, radii, False), shape).join(cells, ["dim", "cell"])
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    done = first.select("vec_id", "vector", F.col("cell").alias("f_cell"))
    pairs = pairs.join(done, ["vec_id", "vector"]).where((F.col("shard") > 0) | (F.col("cell") != F.col("f_cell")))
    found = seed.unionByName(passed(base, pairs))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
