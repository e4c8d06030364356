"""The rules read the connectors once for their steps and once for the places they name, odd and repeated ones too."""

from dataclasses import replace

from pyspark.sql.types import StructField, StructType

from fieldweave.operators.expand import TRACED, expansion
from fieldweave.operators.queries import _tables_repo
from fieldweave.scratch import Scratch
from fieldweave.sources.repository import cached


def test_connectors_are_read_once_for_steps(spark, data, monkeypatch):
    scratch, reads, write = Scratch(spark), {}, Scratch.write
    repo = cached(_tables_repo(spark, data), scratch, TRACED)

    def noted(self, df, name):
        n = sum("Relation" in x and "from_field" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
        reads.update({name: n} if n else {})
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    expansion(repo, scratch)
    # Besides, the names that leave a mapplet are sought in the wires of its inputs.
    assert reads == {"steps-at": 2, "steps": 1}


def test_steps_of_odd_and_repeated_wires(spark, data):
    base = _tables_repo(spark, data)
    wires = [
        ("SRC", "L1", "Source Definition", "ORD", "O1"), ("ORD", "O1", "Expression", "TGT", "C1"), ("ORD", "O1", "Expression", "TGT", "C1"), ("ORD", "O2", None, "TGT", "C1"),
        ("ORD", None, "Expression", "TGT", "C2"), (None, "O3", "Expression", "TGT", "C3"), (None, "L2", "Source Definition", "TGT", "C4"), ("ORD", "O4", "Expression", None, "C5"), ("SRC", "L3", "Source Definition", "ORD", None), ("SRC", "L4", None, "TGT", "C6"),
    ]
    rows = [dict(folder="F", scope_kind="MAPPING", scope="m0", ord=k, from_instance=a, from_field=f, from_type=t, to_instance=b, to_field=g, to_type="") for k, (a, f, t, b, g) in enumerate(wires)]
    like = base.connector.schema
    connector = spark.createDataFrame([tuple(r[f.name] for f in like) for r in rows], StructType([StructField(f.name, f.dataType) for f in like]))
    scratch = Scratch(spark)
    repo = cached(replace(base, connector=connector, port=base.port.limit(0), target_field=base.target_field.limit(0)), scratch, TRACED)
    got = expansion(repo, scratch).select("instance", "field", "ord", "action", "to_instance", "to_field", "hop.label", "skip_equal", "leaf_type", "source_instance", "source_table", "source_field").collect()
    wired = [
        ("ORD", "O1", 0, "LEAF", None, None, None, None, "source", "SRC", "LINEITEM", "L1"), ("TGT", "C1", 1, "DESCEND", "ORD", "O1", "ORD[Expression:O1]", True, None, None, None, None), ("TGT", "C1", 2, "DESCEND", "ORD", "O1", "ORD[Expression:O1]", True, None, None, None, None),
        ("TGT", "C1", 3, "DESCEND", "ORD", "O2", "ORD[:O2]", True, None, None, None, None), ("TGT", "C2", 4, "DESCEND", "ORD", None, None, True, None, None, None, None), ("TGT", "C3", 5, "DESCEND", None, "O3", None, True, None, None, None, None),
        ("TGT", "C4", 6, "LEAF", None, None, None, None, "source", None, None, "L2"), (None, "C5", 7, "DESCEND", "ORD", "O4", "ORD[Expression:O4]", True, None, None, None, None), ("ORD", None, 8, "LEAF", None, None, None, None, "source", "SRC", "LINEITEM", "L3"),
        ("TGT", "C6", 9, "DESCEND", "SRC", "L4", "SRC[:L4]", True, None, None, None, None),
    ]
    ends = [("ORD", "O2"), ("ORD", "O4"), ("SRC", "L4")]
    assert sorted((tuple(r) for r in got if r["action"] == "DESCEND" or r["leaf_type"] == "source"), key=lambda r: r[2]) == wired
    assert sorted((r["instance"], r["field"]) for r in got if r["leaf_type"] not in (None, "source")) == ends
