"""Steps are made for the ports that a trace can come to, however many instances share their definition."""

from fieldweave.operators.expand import TRACED, expansion
from fieldweave.operators.queries import _tables_repo
from fieldweave.scratch import Scratch
from fieldweave.sources.repository import cached

FROM = ["scope", "from_instance", "from_field"]


def test_a_shared_definition_gives_an_instance_its_wired_ports_alone(spark, data):
    scratch = Scratch(spark)
    repo = cached(_tables_repo(spark, data), scratch, TRACED)
    steps = expansion(repo, scratch).where("instance = 'ORD'").select("scope", "instance", "field").distinct()
    wired = repo.connector.where("from_instance = 'ORD'").select(*FROM).distinct()
    assert steps.exceptAll(wired).isEmpty() and wired.exceptAll(steps).isEmpty()
