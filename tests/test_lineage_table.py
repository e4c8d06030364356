import __spark_entry__


def test_lineage_query_makes_no_catalog(spark, data, monkeypatch):
    """The catalogs write tables of their own: a query of the lineage table alone must not wait for them."""
    from fieldweave.scratch import Scratch

    names, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (names.append(name), write(self, df, name))[1])
    assert __spark_entry__.queries()["cq1_lineage_end_to_end"](spark, data).count() > 0
    assert "rows" in names and not [n for n in names if n.startswith(("ports-", "closure-", "mapplet-trace"))]
