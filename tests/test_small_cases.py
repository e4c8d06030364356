"""Small hand-made inputs: golden repositories, rules of ports and forms, orders with cycles, against rows written out."""

import pytest
from oracle import normal, run_sql
from pyspark.sql import functions as F

from fieldweave.functions import expressions as X
from fieldweave.operators import graph, order, report
from fieldweave.operators.queries import _rows, _values
from fieldweave.plans import catalog, dependency, lineage
from fieldweave.scratch import Scratch
from fieldweave.sources.compact import document
from fieldweave.sources.repository import from_json
from fieldweave.sources.sample import ENGINE_B, GOLDEN

CASES = {}


def query(sql):
    def register(f):
        CASES[f.__name__] = (f, sql)
        return f

    return register


_CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d"), ("d", "e"), ("x", "x"), ("x", "e")]


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_values(_CYCLE, 'src, dst')}), walk AS (
  SELECT DISTINCT src AS root, src AS node, [src] AS path FROM e
  UNION ALL SELECT w.root, e.dst, list_append(w.path, e.dst) FROM walk w JOIN e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst))
SELECT root, node AS leaf, array_to_string(path, ',') AS path FROM walk WHERE node NOT IN (SELECT src FROM e)""")
def gr1_path_cycle_guard(spark, sf_dir):
    e = _rows(spark, _CYCLE, "src string, dst string")
    return graph.paths(e.select(F.col("src").alias("root")).distinct(), e, 8, Scratch(spark)).select("root", "leaf", F.array_join("path", ",").alias("path"))


_TASKS = [("Start", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6), ("g", 7), ("h", 8)]
_LINKS = [("Start", "c"), ("Start", "a"), ("a", "b"), ("c", "b"), ("c", "b"), ("b", "e"), ("a", "d"), ("d", "e"), ("f", "g"), ("g", "f"), ("g", "h")]


@query(f"""SELECT * FROM {_values([("Start", 1), ("a", 2), ("c", 3), ("d", 4), ("b", 5), ("e", 6), ("f", 7), ("g", 8), ("h", 9)], 'task, place')}""")
def gr5_topological_order(spark, sf_dir):
    """First in, first out: a fork, a join, a doubled link and a cycle whose nodes come last in document order."""
    nodes = _rows(spark, _TASKS, "task string, ord int").withColumn("wf", F.lit("w"))
    links = _rows(spark, _LINKS, "from_task string, to_task string").withColumn("wf", F.lit("w"))
    return order.topological_order(nodes, links, Scratch(spark), ["wf"]).select("task", F.col("place").cast("int").alias("place"))


_OUTS, _INS = [("REPORTINGID",), ("SOURCENAME2",), ("SOURCENAME1",), ("X",), ("A1",)], [("REPORTINGID2",), ("REPORTINGID3",), ("SOURCENAME",), ("X",), ("A2",), ("X9",)]


@query(f"""SELECT o.out, i.inp, CASE WHEN regexp_extract(i.inp, '^(.*?)([0-9]+)$', 1) = o.out THEN 'fan-in' ELSE 'fan-out' END AS kind FROM (SELECT * FROM {_values(_OUTS, 'out')}) o, (SELECT * FROM {_values(_INS, 'inp')}) i
WHERE o.out <> i.inp AND (regexp_extract(i.inp, '^(.*?)([0-9]+)$', 1) = o.out OR regexp_extract(o.out, '^(.*?)([0-9]+)$', 1) = i.inp)""")
def j12_suffix_match(spark, sf_dir):
    outs, ins = (_rows(spark, r, f"{c} string").withColumn("t", F.lit(1)) for r, c in ((_OUTS, "out"), (_INS, "inp")))
    return report.suffix_matches(outs, ins, ["t"]).select("out", "inp", "kind")


_PORTS = [("A", "INPUT", ""), ("B", "OUTPUT", "A+1"), ("C", "INPUT/OUTPUT", ""), ("v_D", "", "A"), ("E", "", ""), ("F", "", "x"), ("G", "LOCAL VARIABLE", "y"), ("o_H", "OUTPUT", "")]


@query(f"""SELECT port, has_in OR (NOT (has_in OR has_out OR has_var) AND e = '') AS is_in, has_out AS is_out, has_var OR (NOT (has_in OR has_out OR has_var) AND e <> '') AS is_var, CASE WHEN e = '' THEN 'Direct Pass through' ELSE 'Involves Derivation' END AS category
FROM (SELECT *, contains(upper(pt), 'INPUT') AS has_in, contains(upper(pt), 'OUTPUT') AS has_out, contains(upper(pt), 'VARIABLE') OR lower(left(port, 2)) IN ('v_', 'i_', 'o_') AS has_var FROM {_values(_PORTS, 'port, pt, e')})""")
def f9_classify(spark, sf_dir):
    p = _rows(spark, _PORTS, "port string, pt string, e string")
    return p.select("port", X.port_class(F.col("port"), F.col("pt"), F.col("e")).alias("c"), X.category(F.col("e")).alias("category")).select("port", "c.is_in", "c.is_out", "c.is_var", "category")


_LOGIC = [
    ("Expression", "k", "v", "closure"), ("Filter", "filter condition ", "a > 1", "closure"), ("Joiner", "Join Condition", "a = b", "closure"), ("Sorter", "Sort Direction", "ASC", "closure"),
    ("Source Qualifier", "Sql Query", "select 1", "closure"), ("Sequence Generator", "Current Value", "7", "closure"), ("Update Strategy", "Update Strategy Expression", "DD_INSERT", "closure"), ("Rank", "Top/Bottom", "Top", "closure"),
    ("Filter", "other", "x", "closure"), ("Java", "k", "v", "closure"),
]
_LOGIC_OUT = ["closure", "a > 1", "a = b", "ASC", "select 1", "7", "DD_INSERT", "Rank=Top, number of Ranks=", "closure", "closure"]


@query(f"SELECT * FROM {_values([(r[0], r[1], o) for r, o in zip(_LOGIC, _LOGIC_OUT, strict=True)], 'ttype, attr, logic')}")
def f10_business_logic(spark, sf_dir):
    p = _rows(spark, _LOGIC, "ttype string, attr string, value string, closure string")
    none = F.expr("cast(map() as map<string,string>)")
    logic, _ = X.business_logic(F.col("ttype"), F.create_map("attr", "value"), none, F.lit(None).cast("string"), none, F.col("closure"))
    return p.select("ttype", "attr", logic.alias("logic"))


_CROSS = [("Expression", "A", "", 0), ("Expression", "A", "A", 0), ("Expression", "A", "B", 1), ("Expression", "A", "B + 1", 1), ("Expression", "A", "V", 1), ("Router", "A", "B", 1), ("Router", "A", "B + C", 2), ("Router", "A", "", 0)]


@query(f"""SELECT ttype, field, e, CASE WHEN ttype = 'Expression' THEN NOT (e IN ('', field) OR e = 'B') ELSE n > 0 AND NOT (n = 1 AND e = 'B') END AS crossing FROM {_values(_CROSS, 'ttype, field, e, n')}""")
def f11_crossing(spark, sf_dir):
    """`n` is the number of ports an expression names; B is a plain input, V a variable."""
    p = _rows(spark, _CROSS, "ttype string, field string, e string, n int")
    refs = F.when(F.col("n") == 1, F.array(F.regexp_extract("e", "[A-Z]", 0))).when(F.col("n") == 2, F.array(F.lit("B"), F.lit("C"))).otherwise(F.array().cast("array<string>"))
    none = F.expr("cast(map() as map<string,string>)")
    crossing = dependency.crossing(F.col("ttype"), F.col("field"), F.col("e"), refs, F.col("e") == "V", none, F.lit(""))
    return p.select("ttype", "field", "e", crossing.alias("crossing"))


_ASKED, _MAPS, _SESS, _WFS = [("m1",), ("S1",), ("wf",), ("M2",), ("zz",)], [("m1",), ("m2",), ("s1",)], [("S1", "m2"), ("m1", "m2")], [("WF", "m1"), ("WF", "m2")]


@query(f"SELECT * FROM {_values([('m1', 'm1'), ('S1', 'm2'), ('wf', 'm1'), ('wf', 'm2'), ('M2', 'm2')], 'name, mapping')}")
def pf4_identifier_priority(spark, sf_dir):
    return report.resolve_identifier(_rows(spark, _ASKED, "name string"), _rows(spark, _MAPS, "mapping string"), _rows(spark, _SESS, "session string, mapping string"), _rows(spark, _WFS, "workflow string, mapping string"))


_FORMS = [("", "T", ""), ("m9", "T", ""), ("m1", "U", ""), ("m1", "t", "x"), ("m1", "T", ""), ("m1", "T", "b"), ("m2", "V", "")]


@query(f"SELECT * FROM {_values([(*f, s) for f, s in zip(_FORMS, ['blank', 'unknown mapping', 'table is no target', 'wrong instance', 'ambiguous table', 'ready', 'ready'], strict=True)], 'mapping, table_name, instance, state')}")
def pf14_form_state(spark, sf_dir):
    inst = _rows(spark, [("m1", "a", "T"), ("m1", "b", "T"), ("m2", "c", "V")], "mapping string, instance string, table string")
    asked = _rows(spark, _FORMS, "mapping string, table string, instance string")
    return report.form_state(inst.select("mapping"), inst, asked).withColumnRenamed("table", "table_name")


def _repo(spark, text):
    return from_json(_rows(spark, [(document(text),)], "d string"))


_GOLDEN_ROWS = [
    (1, "s1", 1, "LKP_C", "C_TBL", "", "LKP_C.C_TBL[Unconnected Lookup] -> EXP_1.O_A[Expression]", "T1", "A", "", "s2", "A"),
    (2, "s1", 1, "SRC_A", "SRC_A", "Y", "SQ_A.Y[Source Qualifier] -> EXP_1.O_A[Expression]", "T1", "A", "", "s2", "A"),
    (3, "s1", 1, "SRC_A", "SRC_A", "X", "SQ_A.X[Source Qualifier] -> EXP_1.O_A[Expression]", "T1", "A", "", "s2", "A"),
    (4, "s1", 1, "SRC_A", "SRC_A", "Y", "SQ_A.Y[Source Qualifier]", "T1", "B", "", "s2", ""),
    (5, "s2", 2, "T1_SRC", "T1", "A", "SQ_T1.A[Source Qualifier]", "T2", "A", "s1", "", "A"),
]


@query(f"SELECT * FROM {_values(_GOLDEN_ROWS, 'edge_id, session, exec_order, source_instance, source_table, source_field, chain, target_table, target_field, prev_session, next_session, connectors')}")
def cq1_lineage_end_to_end(spark, sf_dir):
    t = lineage.build_lineage(_repo(spark, GOLDEN), "T2_TGT", Scratch(spark)).lineage
    names = {
        "Edge_ID": "edge_id", "Current_Session_name": "session", "Mapping_Execution_Order": "exec_order", "Source_Instance_Name": "source_instance", "Source Table": "source_table", "Source Field Name": "source_field",
        "Transformation Lineage": "chain", "Target Table": "target_table", "Target Field": "target_field", "Prev_session_name": "prev_session", "next_session_name": "next_session", "Connectors": "connectors",
    }
    return t.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


_CATALOG_ROWS = [
    ("EXP_1", "O_A", "Expression", "O_A = IIF(X > 0, X, :LKP.LKP_C(Y))", "Involves Derivation", "X, Y", "O_A"), ("LKP_C", "C_VAL", "Lookup Procedure", "Lookup Table Name: C_TBL", "Direct Pass through", "", "C_VAL"),
    ("SQ_A", "X", "Source Qualifier", "", "Direct Pass through", "X", "X"), ("SQ_A", "Y", "Source Qualifier", "", "Direct Pass through", "Y", "Y"), ("SQ_T1", "A", "Source Qualifier", "", "Direct Pass through", "A", "A"), ("SQ_T1", "B", "Source Qualifier", "", "Direct Pass through", "B", "B"),
]


@query(f"SELECT * FROM {_values(_CATALOG_ROWS, 'name, port, ttype, logic, category, inputs, outputs')}")
def cq2_transformation_catalog(spark, sf_dir):
    scratch = Scratch(spark)
    t = catalog.shown(catalog.transformation_catalog(_repo(spark, GOLDEN), scratch))
    names = {"Transformation Name": "name", "PORT_NAME": "port", "Transformation Type": "ttype", "Business Logic": "logic", "Category": "category", "Input Ports": "inputs", "Output Ports": "outputs"}
    return t.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


_FLAT_ROWS = [("ADJUSTMENT", "Indirect"), ("CREDIT_SCORE", "Direct"), ("ORDER_VALUE", "Indirect"), ("REGION", "Direct")]


@query(f"SELECT * FROM {_values(_FLAT_ROWS, 'source_field, dependency')}")
def cq6_flat_lineage(spark, sf_dir):
    """Which fields decide CUSTOMER_SEGMENT at once, and which only through another computed field."""
    rows = dependency.flat_lineage(_repo(spark, ENGINE_B), Scratch(spark), "m1", "SEG")
    return rows.where("target_field = 'CUSTOMER_SEGMENT'").select("source_field", "dependency")


@pytest.mark.parametrize("name", sorted(CASES))
def test_small_case(spark, data, name):
    made, sql = CASES[name]
    assert normal([r.asDict(recursive=True) for r in made(spark, data).collect()]) == normal(run_sql(sql, data))
