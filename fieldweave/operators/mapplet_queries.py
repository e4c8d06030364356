"""Registered queries of mapplets and of the shorter texts of paths, over what is made of the tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.functions import expressions as X
from fieldweave.operators.dependency_queries import _shaped
from fieldweave.operators.expand import TRACED, expansion
from fieldweave.operators.queries import _tables_repo, query
from fieldweave.operators.trace import roots_of, trace
from fieldweave.plans import catalog, lineage
from fieldweave.scratch import Scratch
from fieldweave.sources.repository import Repository, cached
from fieldweave.tables import table

# A mapplet for each region, with a port for each customer: IN.N -> EXP.A, EXP.R -> OUT.R, shown outside as I and O. R of
# an even customer joins a variable V, made of the customer's A, with the A of the region's next customer. A mapping for
# each nation runs its own customers through its region's mapplet.

_PATHS = """c AS (SELECT c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
  s AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY r ORDER BY c), min(c) OVER (PARTITION BY r)) AS x FROM c),
  p AS (SELECT c, n, r, c AS x FROM s UNION ALL SELECT c, n, r, x FROM s WHERE c % 2 = 0)"""


def _mapplets_repo(spark: SparkSession, sf_dir: str) -> Repository:
    base = _tables_repo(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"), F.concat(F.lit("m"), "n_nationkey").alias("m"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("c"), F.col("c_custkey").cast("int").alias("at"), "m", F.concat(F.lit("mp"), "r").alias("mp"))
    w = Window.partitionBy("mp")
    c = c.select("*", F.coalesce(F.lead("c").over(w.orderBy("c")), F.min("c").over(w)).alias("next"))
    named = lambda prefix, column="c": F.concat(F.lit(prefix), column)
    own, mapping = dict(scope_kind="MAPPLET", scope=F.col("mp")), dict(scope_kind="MAPPING", scope=F.col("m"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    maps, mapplets = n.select("m", F.concat(F.lit("mp"), "r").alias("mp"), F.col("n_nationkey").cast("int").alias("at")), n.select(F.concat(F.lit("mp"), "r").alias("mp"), F.col("r").cast("int").alias("at")).distinct()
    types = {"IN": "Input Transformation", "EXP": "Expression", "OUT": "Output Transformation"}
    inner = [_shaped(mapplets, base.instance, **own, instance=name, type="TRANSFORMATION", transformation_name=name, transformation_type=kind, ord=k) for k, (name, kind) in enumerate(types.items())]
    outer = [_shaped(maps, base.instance, **mapping, instance=name, type=kind, transformation_name=definition, transformation_type="", ord=k) for k, (name, kind, definition) in enumerate((("SRC", "SOURCE", F.lit("S")), ("P", "MAPPLET", F.col("mp")), ("TGT", "TARGET", F.concat(F.lit("T_"), "m"))))]
    even = F.col("c") % 2 == 0
    joined = F.concat(F.lit("CONCAT("), named("V"), F.lit(", "), named("A", "next"), F.lit(")"))
    upper = F.concat(F.lit("UPPER("), named("A"), F.lit(")"))

    def port(rows: DataFrame, of: Column | str, name: str, kind: str = "", expression: Column | str = "", ref: str | None = None, side: str | None = None) -> DataFrame:
        return _shaped(rows, base.port, **own, transformation=of, port=named(name), ord=F.col("at"), porttype=kind, expression=expression, ref_field=named(ref) if ref else None, ref_instancetype=side)

    def wire(scope: dict, a: str, a_field: str, a_type: str, b: str, b_field: str, b_type: str) -> DataFrame:
        return _shaped(c, base.connector, **scope, ord=F.col("at"), from_instance=a, from_field=named(a_field), from_type=a_type, to_instance=b, to_field=named(b_field), to_type=b_type)

    return replace(
        base,
        source_field=_shaped(c, base.source_field, source="S", field=named("F"), ord=F.col("at")),
        target_field=_shaped(c, base.target_field, target=F.concat(F.lit("T_"), "m"), field=named("F"), ord=F.col("at")),
        scope=_shaped(maps, base.scope, **mapping, ord=F.col("at")).unionByName(_shaped(mapplets, base.scope, **own, ord=F.col("at"))),
        instance=union([*inner, *outer]),
        transformation=union([_shaped(mapplets, base.transformation, **own, name=name, type=kind) for name, kind in [*types.items(), (F.col("mp"), "Mapplet")]]),
        port=union([
            port(c, F.col("mp"), "I", ref="N", side="Input Transformation"), port(c, F.col("mp"), "O", ref="R", side="Output Transformation"), port(c, "IN", "N", "OUTPUT"), port(c, "OUT", "R", "INPUT"),
            port(c, "EXP", "A", "INPUT"), port(c.where(even), "EXP", "V", "LOCAL VARIABLE", upper), port(c, "EXP", "R", "OUTPUT", F.when(even, joined).otherwise(upper)),
        ]),
        connector=union([
            wire(own, "IN", "N", types["IN"], "EXP", "A", "Expression"), wire(own, "EXP", "R", "Expression", "OUT", "R", types["OUT"]),
            wire(mapping, "SRC", "F", "Source Definition", "P", "I", "Mapplet"), wire(mapping, "P", "O", "Mapplet", "TGT", "F", "Target Definition"),
        ]),
    )


@query(f"""WITH {_PATHS}
SELECT 'm' || p.n AS mapping, 'F' || p.c AS field, CASE WHEN o.n = p.n THEN 'source' ELSE 'unresolved_mapplet_output' END AS leaf_type, CASE WHEN o.n = p.n THEN 'F' || p.x END AS source_field,
  'IN.N' || p.x || '[Input Transformation] -> EXP.R' || p.c || '[Expression] -> P.O' || p.c || '[Mapplet]' AS chain FROM p JOIN c o ON o.c = p.x""")
def gr3_mapplet_trace(spark, sf_dir):
    """GR3, J15, J16: every target field through its region's mapplet, by exposed names; another nation's customers are not wired."""
    scratch = Scratch(spark)
    repo = cached(_mapplets_repo(spark, sf_dir), scratch, TRACED)
    leaves = trace(roots_of(lineage.target_fields(repo), ["folder", "scope", "instance", "field"]), expansion(repo, scratch), scratch)
    return leaves.select(F.col("root.scope").alias("mapping"), "root.field", "leaf_type", "source_field", X.chain(F.col("hops")).alias("chain"))


@query(r"""WITH c AS (SELECT c_custkey AS c, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
  s AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY r ORDER BY c), min(c) OVER (PARTITION BY r)) AS x FROM c)
SELECT 'mp' || r AS mapplet, 'IN' AS name, 'N' || c AS port, 'Input Transformation' AS ttype, '' AS logic, 'Direct Pass through' AS category, '' AS inputs, 'N' || c AS outputs, '' AS variables FROM s
UNION ALL SELECT 'mp' || r, 'EXP', 'V' || c, 'Expression', 'V' || c || ' = UPPER(A' || c || ')', 'Involves Derivation', 'A' || c, '', 'V' || c FROM s WHERE c % 2 = 0
UNION ALL SELECT 'mp' || r, 'EXP', 'R' || c, 'Expression', CASE WHEN c % 2 = 0 THEN 'V' || c || ' = UPPER(A' || c || ')' || chr(10) || 'R' || c || ' = CONCAT(V' || c || ', A' || x || ')' ELSE 'R' || c || ' = UPPER(A' || c || ')' END, 'Involves Derivation',
  CASE WHEN c % 2 = 1 OR c = x THEN 'A' || c ELSE least('A' || c, 'A' || x) || ', ' || greatest('A' || c, 'A' || x) END, 'R' || c, CASE WHEN c % 2 = 0 THEN 'V' || c ELSE '' END FROM s""")
def cq3_mapplet_transformations(spark, sf_dir):
    """CQ3, AG3: the ports inside the mapplets, with what their expressions lead back to."""
    t = catalog.shown(catalog.transformation_catalog(_mapplets_repo(spark, sf_dir), Scratch(spark), "MAPPLET"))
    names = {"Mapplet_Name": "mapplet", "Transformation Name": "name", "PORT_NAME": "port", "Transformation Type": "ttype", "Business Logic": "logic", "Category": "category", "Input Ports": "inputs", "Output Ports": "outputs", "Custom / Variable Ports": "variables"}
    return t.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query(f"""WITH {_PATHS}
SELECT DISTINCT 'm' || n_nationkey AS mapping, 'mp' || p.r AS mapplet, 'I' || p.x AS input_field, CASE WHEN o.n = n_nationkey THEN 'SRC.F' || p.x || '[Source Definition] -> ' ELSE '' END || 'IN.N' || p.x || '[Input Transformation] -> EXP.R' || p.c || '[Expression] -> OUT.R' || p.c || '[Output Transformation]' || CASE WHEN p.n = n_nationkey THEN ' -> TGT.F' || p.c || '[Target Definition]' ELSE '' END AS path,
  'O' || p.c AS output_field, CASE WHEN o.n = n_nationkey THEN 'SRC' ELSE '' END AS up_name, CASE WHEN o.n = n_nationkey THEN 'F' || p.x ELSE '' END AS up_field, CASE WHEN p.n = n_nationkey THEN 'TGT' ELSE '' END AS down_name, CASE WHEN p.n = n_nationkey THEN 'F' || p.c ELSE '' END AS down_field
FROM nation JOIN p ON p.r = n_regionkey JOIN c o ON o.c = p.x""")
def cq4_mapplet_boundaries(spark, sf_dir):
    """CQ4: every path from an output of a nation's mapplet to an input, with what the nation's mapping wires there."""
    scratch = Scratch(spark)
    t = catalog.mapplet_catalog(cached(_mapplets_repo(spark, sf_dir), scratch), scratch)
    names = ["mapping", "mapplet", "input_field", "path", "output_field", "up_name", "up_field", "down_name", "down_field"]
    return t.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(catalog.MAPPLET_DISPLAY, names, strict=True)])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its turns as hops, each named by its role and of type even or odd."""
    turn = F.col("turn")
    kind = F.when(turn % 2 == 0, "even").otherwise("odd")
    hops = F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", kind.alias("kind")))), lambda e: X.hop(e["role"], e["kind"], e["turn"].cast("string"), e["role"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(hops.alias("hops"))


_TURNS = "s AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM conversations), d AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(kind) OVER w IS NOT DISTINCT FROM kind AS same FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"""WITH {_TURNS.replace("ORDER BY turn", "ORDER BY turn DESC")} SELECT conv_id, string_agg(role || '[' || kind || ']', ' -> ' ORDER BY turn DESC) AS chain FROM d WHERE NOT same GROUP BY conv_id""")
def f7_short_chain(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", X.chain_by_type(F.col("hops")).alias("chain"))


@query(f"""WITH {_TURNS} SELECT conv_id, '[' || string_agg('{{"name":"' || role || '","type":"' || kind || '","field":"' || turn || '","mapping":"c' || conv_id || '","scope":"mapping"}}', ',' ORDER BY turn DESC) || ']' AS data FROM d WHERE NOT same GROUP BY conv_id""")
def snk8_chain_json(spark, sf_dir):
    """SNK8: the hops of a conversation as JSON."""
    return _turns(spark, sf_dir).select("conv_id", X.chain_data(F.col("hops"), F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("data"))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' Source Definition' WHEN 1 THEN 'TARGET definition ' WHEN 2 THEN 'Mapplet' WHEN 3 THEN 'source' WHEN 4 THEN o_orderpriority END AS t FROM orders)
SELECT o_orderkey, k AS kind, lower(k) || ':w' || o_orderkey % 7 || '::I' || '::O' || o_orderkey AS node FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 3) THEN 'SOURCE' WHEN o_orderkey % 6 = 1 THEN 'TARGET' WHEN o_orderkey % 6 = 2 THEN 'MAPPLET' ELSE 'TRANSFORMATION' END AS k FROM o)""")
def f14_instance_kinds(spark, sf_dir):
    """the kind that a declared type stands for, and the node that it names; an order each."""
    key = F.col("o_orderkey")
    declared = F.when(key % 6 == 0, " Source Definition").when(key % 6 == 1, "TARGET definition ").when(key % 6 == 2, "Mapplet").when(key % 6 == 3, "source").when(key % 6 == 4, F.col("o_orderpriority"))
    kind = X.instance_kind(declared)
    node = X.node_id(F.lower(kind), F.concat(F.lit("w"), (key % 7).cast("string")), F.lit("I"), F.concat(F.lit("O"), key.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), node.alias("node"))
