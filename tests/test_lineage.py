"""Repositories small enough to trace by hand: one rule each."""

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import expressions as X
from fieldweave.operators import graph
from fieldweave.operators.expand import expansion
from fieldweave.operators.trace import capped, distinct_leaves, roots_of, trace
from fieldweave.plans import catalog, dependency, lineage
from fieldweave.scratch import Scratch
from fieldweave.sources import sinks
from fieldweave.sources.compact import document
from fieldweave.sources.repository import cached, from_json, read_json
from fieldweave.sources.sample import ENGINE_B, GOLDEN

TOP = "SOURCE{NAME=S}[SOURCEFIELD{NAME=A} SOURCEFIELD{NAME=B}] TARGET{NAME=T}[TARGETFIELD{NAME=X} TARGETFIELD{NAME=Y}]"
ENDS = "INSTANCE{NAME=S;TYPE=SOURCE;TRANSFORMATION_NAME=S} INSTANCE{NAME=T;TYPE=TARGET;TRANSFORMATION_NAME=T}"


def repo_of(spark, text):
    return from_json(spark.createDataFrame([(document(text),)], "d string"))


def leaves(spark, mapping, top=TOP, more=""):
    """(field, leaf type, source table, source field, chain) of every target field of mapping m."""
    repo = cached(repo_of(spark, f"FOLDER{{NAME=F}}[{top} {more} MAPPING{{NAME=m}}[{ENDS} {mapping}]]"), scratch := Scratch(spark))
    roots = roots_of(lineage.target_fields(repo), ["folder", "scope", "instance", "field"])
    found = distinct_leaves(capped(trace(roots, expansion(repo, scratch), scratch)))
    rows = found.select("root.field", "leaf_type", "source_table", "source_field", X.chain(F.col("hops")).alias("chain"), "ord_path").orderBy("field", "ord_path").collect()
    return [tuple(r)[:5] for r in rows]


def test_router_reference_and_unwired_target(spark):
    got = leaves(spark, """
      TRANSFORMATION{NAME=R;TYPE=Router}[TRANSFORMFIELD{NAME=I1;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=O1;PORTTYPE=OUTPUT;REF_FIELD=I1}]
      INSTANCE{NAME=R;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=R;TRANSFORMATION_TYPE=Router}
      CONNECTOR S.A(Source Definition) -> R.I1 CONNECTOR R.O1(Router) -> T.X""")
    assert got == [("X", "source", "S", "A", "R.O1[Router]"), ("Y", "unmapped", None, None, "")]


def test_union_by_position(spark):
    got = leaves(spark, """
      TRANSFORMATION{NAME=U;TYPE=Custom Transformation}[GROUP{NAME=G1;TYPE=INPUT} GROUP{NAME=G2;TYPE=INPUT} GROUP{NAME=O;TYPE=OUTPUT}
        TRANSFORMFIELD{NAME=P1;GROUP=G1} TRANSFORMFIELD{NAME=Q1;GROUP=G1} TRANSFORMFIELD{NAME=P2;GROUP=G2} TRANSFORMFIELD{NAME=Q2;GROUP=G2} TRANSFORMFIELD{NAME=P;GROUP=O} TRANSFORMFIELD{NAME=Q;GROUP=O}]
      INSTANCE{NAME=U;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=U}
      CONNECTOR S.A(Source Definition) -> U.P1 CONNECTOR S.B(Source Definition) -> U.P2 CONNECTOR S.B(Source Definition) -> U.Q1 CONNECTOR S.A(Source Definition) -> U.Q2
      CONNECTOR U.P(Custom Transformation) -> T.X CONNECTOR U.Q(Custom Transformation) -> T.Y""")
    assert [(g[0], g[3]) for g in got] == [("X", "A"), ("X", "B"), ("Y", "B"), ("Y", "A")]


def test_lookup_literal_missing_and_cycle(spark):
    got = leaves(spark, """
      TRANSFORMATION{NAME=L;TYPE=Lookup Procedure}[TRANSFORMFIELD{NAME=V;PORTTYPE=LOOKUP/OUTPUT} TABLEATTRIBUTE{NAME=Lookup table name;VALUE=LT}]
      TRANSFORMATION{NAME=E;TYPE=Expression}[TRANSFORMFIELD{NAME=D;PORTTYPE=OUTPUT;EXPRESSION=SYSDATE} TRANSFORMFIELD{NAME=C1;PORTTYPE=INPUT/OUTPUT} TRANSFORMFIELD{NAME=C2;PORTTYPE=INPUT/OUTPUT}]
      INSTANCE{NAME=L;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=L} INSTANCE{NAME=E;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=E} INSTANCE{NAME=N;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=NODEF}
      CONNECTOR L.V(Lookup Procedure) -> T.X CONNECTOR E.D(Expression) -> T.X CONNECTOR N.Z(Expression) -> T.X CONNECTOR GONE.Z(Expression) -> T.X
      CONNECTOR E.C1(Expression) -> E.C2 CONNECTOR E.C2(Expression) -> E.C1 CONNECTOR E.C1(Expression) -> T.Y""")
    assert [(g[0], g[1], g[2]) for g in got] == [("X", "connected_lookup", "LT"), ("X", "literal_or_unresolved", None), ("X", "unresolved_transformation", None), ("X", "unmapped", None)]
    assert got[0][4] == "L.V[Lookup] -> L.V[Lookup Procedure]"


MAPPLET = """
  MAPPLET{NAME=MP}[
    TRANSFORMATION{NAME=MP;TYPE=Mapplet}[TRANSFORMFIELD{NAME=N1;REF_FIELD=N;REF_INSTANCETYPE=Input Transformation} TRANSFORMFIELD{NAME=M1;REF_FIELD=M;REF_INSTANCETYPE=Input Transformation} TRANSFORMFIELD{NAME=O1;REF_FIELD=O;REF_INSTANCETYPE=Output Transformation}]
    TRANSFORMATION{NAME=IN;TYPE=Input Transformation}[TRANSFORMFIELD{NAME=N;PORTTYPE=OUTPUT} TRANSFORMFIELD{NAME=M;PORTTYPE=OUTPUT}]
    TRANSFORMATION{NAME=CC;TYPE=Expression}[TRANSFORMFIELD{NAME=N;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=M;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=R;PORTTYPE=OUTPUT;EXPRESSION=CONCAT(N, M)}]
    TRANSFORMATION{NAME=OUT;TYPE=Output Transformation}[TRANSFORMFIELD{NAME=O;PORTTYPE=INPUT}]
    INSTANCE{NAME=IN;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=IN;TRANSFORMATION_TYPE=Input Transformation} INSTANCE{NAME=CC;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=CC;TRANSFORMATION_TYPE=Expression}
    INSTANCE{NAME=OUT;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=OUT;TRANSFORMATION_TYPE=Output Transformation}
    CONNECTOR IN.N(Input Transformation) -> CC.N CONNECTOR IN.M(Input Transformation) -> CC.M CONNECTOR CC.R(Expression) -> OUT.O ]
"""


def test_mapplet_with_renamed_ports_and_two_instances(spark):
    got = leaves(spark, """
      INSTANCE{NAME=P1;TYPE=MAPPLET;TRANSFORMATION_NAME=MP} INSTANCE{NAME=P2;TYPE=MAPPLET;TRANSFORMATION_NAME=MP}
      CONNECTOR S.A(Source Definition) -> P1.N1 CONNECTOR S.B(Source Definition) -> P1.M1 CONNECTOR P1.O1(Mapplet) -> P2.N1 CONNECTOR S.B(Source Definition) -> P2.M1 CONNECTOR P2.O1(Mapplet) -> T.X""", more=MAPPLET)
    assert [(g[1], g[3]) for g in got if g[0] == "X"] == [("source", "A"), ("source", "B"), ("source", "B")]
    assert got[0][4].endswith("P2.O1[Mapplet]") and "CC.R[Expression]" in got[0][4]


def test_cycle_through_mapplets(spark):
    got = leaves(spark, """
      INSTANCE{NAME=P1;TYPE=MAPPLET;TRANSFORMATION_NAME=MP}
      CONNECTOR P1.O1(Mapplet) -> P1.N1 CONNECTOR S.B(Source Definition) -> P1.M1 CONNECTOR P1.O1(Mapplet) -> T.X""", more=MAPPLET)
    assert {(g[1], g[3]) for g in got if g[0] == "X"} == {("cyclic_mapplet_reference", None), ("source", "B")}


def test_mapplet_catalog(spark):
    text = f"FOLDER{{NAME=F}}[{TOP} {MAPPLET} MAPPING{{NAME=m}}[{ENDS} INSTANCE{{NAME=P1;TYPE=MAPPLET;TRANSFORMATION_NAME=MP}} CONNECTOR S.A(Source Definition) -> P1.N1 CONNECTOR P1.O1(Mapplet) -> T.X(Target Definition)]]"
    repo = cached(repo_of(spark, text), scratch := Scratch(spark))
    rows = {r["Input Transformation Field"]: r for r in catalog.mapplet_catalog(repo, scratch).collect()}
    assert set(rows) == {"N1", "M1"}
    assert rows["N1"]["Transformation_lineage"].startswith("S.A[Source Definition] -> IN.N[Input Transformation]")
    assert rows["N1"]["Transformation_lineage"].endswith("OUT.O[Output Transformation] -> T.X[Target Definition]")
    assert rows["M1"]["Upstream HOP/Prev_Transformation_name"] == ""
    inner = catalog.transformation_catalog(repo, scratch, "MAPPLET").where("PORT_NAME = 'R'").first()
    assert (inner["Mapplet_Name"], inner["Input Ports"], inner["Business Logic"]) == ("MP", "M, N", "R = CONCAT(N, M)")


def test_more_leaves_than_the_cap(spark):
    wires = " ".join(f"CONNECTOR S.F{k}(Source Definition) -> T.X" for k in range(305))
    got = [g for g in leaves(spark, wires) if g[0] == "X"]
    assert len(got) == 301 and got[-1][1] == "truncated_output" and "[5 additional" in got[-1][4]


def test_unknown_target(spark):
    with pytest.raises(lineage.UnknownTarget):
        lineage.build_lineage(repo_of(spark, GOLDEN), "nothing", Scratch(spark))


def test_empty_document(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"root": {"children": []}}')
    repo = read_json(spark, str(tmp_path / "r.json"))
    assert repo.connector.count() == 0 and repo.port.columns[:3] == ["folder", "scope_kind", "scope"]


def test_flat_hop_and_graph(spark):
    repo = repo_of(spark, ENGINE_B)
    flat = dependency.flat_lineage(repo, Scratch(spark)).collect()
    own = {r["source_field"]: r["dependency"] for r in flat if r["mapping"] == "m1"}
    assert own == {"ORDER_VALUE": "Indirect", "ADJUSTMENT": "Indirect", "CREDIT_SCORE": "Direct", "REGION": "Direct"}
    m2 = [r for r in flat if r["mapping"] == "m2"]
    assert [(r["source_table"], r["target_table"]) for r in m2] == [("SEG", "REP")]
    linked = [r for r in flat if r["links"]]
    assert {r["links"] for r in linked} == {"s1.SEG.CUSTOMER_SEGMENT -> s2.SEG.customer_segment"} and len(linked) == 4
    hops = dependency.hop_lineage(repo, Scratch(spark)).where("mapping = 'm1'")
    assert hops.where("transformation_type = 'Source Table'").count() == 8 and hops.where("transformation_type = '(cycle)'").count() == 0
    nodes, edges = dependency.attribute_graph(repo, Scratch(spark), "m2", "REP", "SEGMENT")
    kinds = {r["id"]: r["kind"] for r in nodes.collect()}
    assert kinds["mapping:m2::REP::SEGMENT"] == "TARGET_FINAL"
    assert edges.where("style = 'flow'").count() >= 2 and edges.where("style = 'logic'").count() >= 5


def test_reachable_over_a_chain_of_more_than_60(spark):
    edges = spark.range(62).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    assert graph.reachable(spark.range(1).select(F.col("id").alias("node")), edges, Scratch(spark)).count() == 63


def test_levels_tell_a_cycle(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_levels(nodes, edges, Scratch(spark))
    assert {tuple(r) for r in graph.longest_levels(nodes, edges.where("src <> 'c'"), Scratch(spark)).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_documents_keep_apart(spark):
    """Names are resolved within a document: a node before the folder, and folders and tables of one name."""
    one = document("FOLDER{NAME=F}[SOURCE{NAME=S}[SOURCEFIELD{NAME=A}]] FOLDER{NAME=G}[SOURCE{NAME=S}[SOURCEFIELD{NAME=Z}]]")
    two = document("NOTE{NAME=N} FOLDER{NAME=F}[SOURCE{NAME=S}[SOURCEFIELD{NAME=B}] SOURCE{NAME=S}[SOURCEFIELD{NAME=C}]]")
    repo = from_json(spark.createDataFrame([(one,), (two,)], "d string"))
    assert sorted(map(tuple, repo.source_field.select("folder", "source", "field").collect())) == [("F", "S", "A"), ("F", "S", "C")]


def test_stored_procedure_attributes_keep_their_order(spark):
    text = "TRANSFORMATION{NAME=P;TYPE=Stored Procedure}[TABLEATTRIBUTE{NAME=Zeta;VALUE=1} TABLEATTRIBUTE{NAME=Stored Procedure Name;VALUE=sp} TABLEATTRIBUTE{NAME=Alpha;VALUE=2}]"
    repo = repo_of(spark, f"FOLDER{{NAME=F}}[{text}]")
    none = F.expr("cast(map() as map<string,string>)")
    logic, more = X.business_logic(F.col("type"), F.col("attrs"), none, F.lit(None).cast("string"), none, F.lit(""))
    assert tuple(repo.transformation.select(logic, more).first()) == ("sp", "Zeta: 1; Alpha: 2")


def test_long_chains_reach_their_source(spark):
    """More than 60 hops are followed to their end."""
    edges = spark.createDataFrame([(f"P{k + 1}", f"P{k}") for k in range(69)], "src string, dst string").coalesce(1)
    assert graph.reachable(spark.createDataFrame([("P69",)], "node string").coalesce(1), edges, Scratch(spark)).count() == 70


@pytest.mark.parametrize("before", [True, False])
def test_closest_over_blocks_and_hot_keys(spark, before):
    import numpy as np

    from fieldweave.operators import stitch

    rng = np.random.default_rng(6)
    events = [(None if k % 50 == 0 else "a" if k % 3 else f"k{k % 5}", int(rng.integers(-300_000, 300_000)), f"e{k}") for k in range(400)]
    rows = [(None if k % 40 == 0 else "a" if k % 3 else f"k{k % 5}", int(rng.integers(-300_000, 300_000)), k) for k in range(500)] + [("a", 7, 1000), ("a", 7, 1001)]
    e, r = spark.createDataFrame(events, "k string, at long, name string"), spark.createDataFrame(rows, "k string, o long, id long")
    got = {x["id"]: (x["f_at"], x["f_name"]) for x in stitch.closest(r, e, ["k"], "o", "at", before, ["name"], "f_").collect()}
    for k, o, i in rows:
        fit = [(at, n) for key, at, n in events if key is not None and key == k and (at < o if before else at > o)]
        best = (max if before else min)((at for at, _ in fit), default=None)
        assert got[i] == ((best, min(n for at, n in fit if at == best)) if fit else (None, None))


def test_html_page_names_cut_sheets(spark):
    rows, none = spark.range(5), spark.range(0)
    page = sinks.html_page(lineage.Report(rows, rows.limit(3), none, none), max_rows=3)
    assert "Lineage (the first 3 rows of more)" in page and "Transformations (" not in page and page.count('["id"]') == 2
