"""The catalogs join a few instances, each with very many ports, by broadcasts: their ports are not dealt by so few names."""

import __spark_entry__
from fieldweave.scratch import Scratch


def test_ports_are_not_dealt_by_instance(spark, data, monkeypatch):
    plans, write = {}, Scratch.write

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    __spark_entry__.queries()["cq3_mapplet_transformations"](spark, data)
    joins = [line for line in plans["ports-MAPPLET"].splitlines() if "Join Inner" in line and "p_transformation" in line]
    assert joins and all("strategy=broadcast" in line for line in joins), joins
