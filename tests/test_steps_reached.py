"""Steps are made for the ports of mapplets that a trace can come to, as it goes into mapplets and out of them."""

from fieldweave.operators.expand import TRACED, expansion
from fieldweave.operators.queries import QUERIES
from fieldweave.scratch import Scratch
from fieldweave.sources.repository import cached

#: Its module can't be the first of the queries to be imported.
_mapplets_repo = QUERIES["gr3_mapplet_trace"].__globals__["_mapplets_repo"]
FROM = ["scope", "from_instance", "from_field"]


def test_a_mapplets_outputs_have_steps_where_they_are_wired(spark, data):
    scratch = Scratch(spark)
    repo = cached(_mapplets_repo(spark, data), scratch, TRACED)
    steps = expansion(repo, scratch).where("instance = 'P'")
    out = steps.where("field like 'O%'").select("scope", "instance", "field")
    assert out.exceptAll(repo.connector.where("from_instance = 'P'").select(*FROM)).isEmpty() and not out.isEmpty()
    # Internal names that a port exposes are left by that port.
    assert steps.where("field like 'N%'").isEmpty()
