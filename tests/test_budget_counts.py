"""A hop of a trace with a small budget counts the states of roots once, and seeks its steps without the limits."""

import __spark_entry__
from fieldweave.scratch import Scratch


def test_states_are_counted_once_a_hop_and_steps_sought_without_limits(spark, data, monkeypatch):
    plans, write = {}, Scratch.write

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    rows = __spark_entry__.queries()["gr4_budget"](spark, data)
    assert rows.where("leaf_type = 'truncated'").count() > 0
    assert "trace-limits0" in plans and "count(1)" in plans["trace-large0"] and "count(1)" not in plans["trace-limits0"]
    assert "limit" not in plans["trace-near1"]
