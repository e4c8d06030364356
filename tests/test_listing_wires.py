"""A listing makes no wires to instances that were not chosen, and deals no fields by the few requests."""

from fieldweave.operators.queries import QUERIES
from fieldweave.scratch import Scratch


def test_wires_to_other_instances_are_not_made(spark, data, monkeypatch):
    plans, write = {}, Scratch.write

    def told(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", told)
    rows = QUERIES["cq8_listing"](spark, data)
    assert "l_orderkey" not in plans["listing-fields"] and "o_orderkey" in plans["listing-fields"]
    # Requests that are not ready are shown without a field.
    assert rows.where("field is null and state <> 'ready'").count() == rows.where("state <> 'ready'").count() > 0
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
