"""The catalog walks only the ports that name others, and lists the same for repeated, blank and null ones as a whole walk."""

from dataclasses import replace

from pyspark.sql.types import StructField, StructType

import __spark_entry__
from fieldweave.operators.queries import _tables_repo
from fieldweave.plans import catalog
from fieldweave.scratch import Scratch

SHOWN = ["Transformation Name", "PORT_NAME", "Business Logic", "Input Ports", "Output Ports", "Custom / Variable Ports", "_Mapping", "_Port"]


def _catalog(spark, data, ports):
    base = _tables_repo(spark, data)
    table = lambda rows, like: spark.createDataFrame([tuple(r.get(c) for c in like.columns) for r in rows], StructType([StructField(f.name, f.dataType) for f in like.schema]))
    at = dict(folder="F", scope_kind="MAPPING", attrs={})
    scopes = ("m1", "m2")
    repo = replace(
        base,
        instance=table([dict(at, scope=m, instance="I", type="TRANSFORMATION", transformation_name="T", transformation_type="Expression", ord=1) for m in scopes], base.instance),
        transformation=table([dict(at, scope=m, name="T", type="Expression") for m in scopes], base.transformation),
        port=table([dict(at, scope=m, transformation="T", port=p, ord=k, porttype=kind, expression=e) for k, (m, p, kind, e) in enumerate(ports)], base.port),
    )
    return catalog.transformation_catalog(repo, Scratch(spark)).select(*SHOWN)


def test_closures_of_repeated_blank_and_null_ports(spark, data):
    ports = [
        ("m1", "A", "INPUT", ""), ("m1", "B", "INPUT/OUTPUT", ""), ("m1", "C", "OUTPUT", "A + D"), ("m1", "D", "LOCAL VARIABLE", "B || C"),
        ("m1", None, "OUTPUT", "A"), ("m1", "E", "OUTPUT", None), ("m1", "", "OUTPUT", ""), (None, "A", "OUTPUT", ""),
        # Repeated: one row alike, one as a plain input with an expression.
        ("m2", "A", "INPUT/OUTPUT", ""), ("m2", "A", "INPUT/OUTPUT", ""), ("m2", "B", "OUTPUT", "A"), ("m2", "B", "OUTPUT", "A"), ("m2", "C", "OUTPUT", ""), ("m2", "C", "INPUT", "B"),
    ]
    line = "\n".join
    assert sorted(map(tuple, _catalog(spark, data, ports).collect())) == sorted([
        ("I", "", "", "", "", "", "m1", ""),
        ("I", "A", "", "A", "A", "", "m2", "A"),
        ("I", "B", line(["B = A"] * 4), "A", "B", "A", "m2", "B"),
        ("I", "B", "", "B", "B", "", "m1", "B"),
        ("I", "C", line(["D = B || C", "C = A + D"]), "A, B", "C", "B, D", "m1", "C"),
        ("I", "C", line(["B = A"] * 2 + ["C = B"]), "A", "C", "A, B", "m2", "C"),
        ("I", "D", line(["C = A + D", "D = B || C"]), "A, B", "", "B, C, D", "m1", "D"),
        ("I", "E", "", "", "E", "", "m1", "E"),
    ])
    assert _catalog(spark, data, []).isEmpty()


def test_ports_that_name_no_other_are_not_walked(spark, data, monkeypatch):
    walked, first = [], catalog.first_visits
    monkeypatch.setattr(catalog, "first_visits", lambda roots, *rest: walked.append(roots.count()) or first(roots, *rest))
    rows = __spark_entry__.queries()["cq2_transformation_catalog"](spark, data)
    assert walked == [0] and rows.count() > 0
