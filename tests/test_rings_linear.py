"""Components and broken cycles of suppliers times customers: no table that is written grows with their product."""

import pytest

from fieldweave.operators.queries import QUERIES
from fieldweave.scratch import Scratch


@pytest.fixture
def crowd(spark, tmp_path):
    """70 customers and 50 suppliers of one nation, another nation without suppliers."""
    spark.range(70).selectExpr("id as c_custkey", "7 as c_nationkey").union(spark.range(100, 103).selectExpr("id", "8")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(50).selectExpr("id as s_suppkey", "7 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


@pytest.fixture
def written(monkeypatch):
    sizes, write = [], Scratch.write

    def counting(self, df, name):
        held = write(self, df, name)
        sizes.append(held.count())
        return held

    monkeypatch.setattr(Scratch, "write", counting)
    return sizes


def test_components(spark, crowd, written):
    got = {r["node"]: r["component"] for r in QUERIES["gr12_components"](spark, crowd).collect()}
    assert len(got) == 123 and got["C13"] == "C10" and got["S3"] == "S3" and got["C102"] == "C100"
    assert max(written) < 400


def test_broken_cycles(spark, crowd, written):
    rows = QUERIES["gr12_broken_cycles"](spark, crowd).collect()
    assert sum(r["src"].startswith("S") for r in rows) == 50 * 70 and {r["src"] for r in rows if r["dropped"]} == {f"C{7 * k + 6}" for k in range(10)} | {"C102"}
    assert max(written) < 400
