"""Every registered query of the lineage engine against its SQL."""

import pytest
from oracle import normal, run_sql

from fieldweave.operators.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, name):
    got = [r.asDict(recursive=True) for r in QUERIES[name](spark, data).collect()]
    assert normal(got) == normal(run_sql(ORACLE_SQL[name], data))
