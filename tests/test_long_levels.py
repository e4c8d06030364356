import pytest

from fieldweave.operators import graph
from fieldweave.scratch import Scratch


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 150, a way of two steps beside each of its edges to a third node, and a node of its own."""
    names, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    nodes = spark.range(151).selectExpr("cast(id as int) as node")
    edges = spark.range(149).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst").union(spark.range(0, 146, 3).selectExpr("cast(id as int)", "cast(id + 3 as int)"))
    assert {tuple(r) for r in graph.longest_levels(nodes, edges, Scratch(spark)).collect()} == {(k, k % 150) for k in range(151)}
    assert len(names) < 100


@pytest.mark.parametrize("back", [(40, 3), (39, 39)])
def test_a_cycle_far_along_is_told(spark, back):
    nodes = spark.range(60).selectExpr("cast(id as int) as node")
    edges = spark.range(59).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst").union(spark.createDataFrame([back], "src int, dst int"))
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_levels(nodes, edges, Scratch(spark))


def test_distances(spark):
    edges = spark.createDataFrame([("s", "h", 0), ("h", "c", 1), ("b", "c", 1), ("a", "b", 1), ("h", "d", 1)], "src string, dst string, w int")
    nodes = spark.createDataFrame([(x,) for x in "shcbad"], "node string")
    assert {tuple(r) for r in graph.longest_levels(nodes, edges, Scratch(spark)).collect()} == {("s", 0), ("h", 0), ("c", 2), ("b", 1), ("a", 0), ("d", 1)}
