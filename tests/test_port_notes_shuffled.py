import re

from fieldweave.operators import queries  # noqa: F401
from fieldweave.operators.dependency_queries import _regions_repo
from fieldweave.plans import dependency
from fieldweave.scratch import Scratch
from fieldweave.sources.repository import cached


def test_what_is_told_of_ports_is_not_broadcast(spark, data, monkeypatch):
    """The last join of a flow's nodes is that with a row for each port; Spark may not choose to broadcast it by its file."""
    plans, write = {}, Scratch.write

    def noting(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noting)
    scratch = Scratch(spark)
    dependency.flow(cached(_regions_repo(spark, data), scratch), scratch)
    assert "rightHint=(strategy=merge)" in re.search(r"Join LeftOuter.*", plans["flow-nodes"])[0]
