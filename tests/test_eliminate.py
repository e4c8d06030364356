from fieldweave.operators import graph
from fieldweave.scratch import Scratch


def _chain(spark, n):
    """Rings of three, each leading to the next."""
    edges = [(3 * i + a, 3 * i + b) for i in range(n) for a, b in ((0, 1), (1, 2), (2, 0))] + [(3 * i, 3 * i + 3) for i in range(n - 1)]
    return spark.createDataFrame([(k,) for k in range(3 * n)], "node int"), spark.createDataFrame(edges, "src int, dst int")


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    nodes, edges = _chain(spark, 60)
    rounds, core, _ = graph.eliminate(edges, Scratch(spark), "e")
    assert core.isEmpty() and len(rounds) <= 20
    got = {r["node"]: r["component"] for r in graph.strong_components(nodes, edges, Scratch(spark)).collect()}
    assert got == {k: k - k % 3 for k in range(180)}
