"""Registered queries of the lineage engine and the SQL that says the same.

Where a query needs a repository-shaped input, it is derived from the parquet tables by the same rule in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import expressions as X
from fieldweave.operators import graph, order, report, resolve, stitch
from fieldweave.operators.expand import TRACED, expansion
from fieldweave.operators.trace import roots_of, trace
from fieldweave.plans import lineage
from fieldweave.scratch import Scratch, numbered
from fieldweave.sources.repository import Repository, cached
from fieldweave.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)


def _values(rows: list[tuple], columns: str) -> str:
    """The same rows as SQL."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


# Graphs derived from the tables: line items lead to orders, customers, nations and regions.

_EDGES = """edges AS (
  SELECT DISTINCT 'L' || l_orderkey || '.' || l_linenumber AS src, 'O' || l_orderkey AS dst FROM lineitem
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"""


def _node(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), F.concat_ws(".", *[F.col(c).cast("string") for c in columns]))


def _edges(spark: SparkSession, sf_dir: str, names: str = "LOCN") -> DataFrame:
    parts = {
        "L": lambda: table(spark, sf_dir, "lineitem").select(_node("L", "l_orderkey", "l_linenumber").alias("src"), _node("O", "l_orderkey").alias("dst")).distinct(),
        "O": lambda: table(spark, sf_dir, "orders").select(_node("O", "o_orderkey").alias("src"), _node("C", "o_custkey").alias("dst")),
        "C": lambda: table(spark, sf_dir, "customer").select(_node("C", "c_custkey").alias("src"), _node("N", "c_nationkey").alias("dst")),
        "N": lambda: table(spark, sf_dir, "nation").select(_node("N", "n_nationkey").alias("src"), _node("R", "n_regionkey").alias("dst")),
    }
    out = None
    for k in names:
        out = parts[k]() if out is None else out.unionByName(parts[k]())
    return out


def _hops(spark: SparkSession, sf_dir: str, names: str) -> list[DataFrame]:
    return [_edges(spark, sf_dir, k) for k in names]


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (
  SELECT src AS root, src AS node, [src] AS path FROM edges WHERE src LIKE 'L%'
  UNION ALL SELECT w.root, e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.node)
SELECT DISTINCT root, node AS leaf, array_to_string(path, ' -> ') AS path FROM walk WHERE node LIKE 'R%'""")
def gr1_backward_trace(spark, sf_dir):
    """From every line item to its region. The kinds of nodes are known, so each hop joins with that kind's edges alone."""
    rows, *rest = _hops(spark, sf_dir, "LOCN")
    walk = rows.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    for e in rest:
        walk = walk.join(e, walk.node == e.src).select("root", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
    return walk.select("root", F.col("node").alias("leaf"), F.array_join("path", " -> ").alias("path"))


@query("""SELECT 'O' || o_orderkey AS root, 'R' || n_regionkey AS leaf, CAST((o_orderpriority = '1-URGENT')::INT + (c_mktsegment = 'BUILDING')::INT + (n_regionkey < 2)::INT AS BIGINT) AS crossings,
  CASE WHEN (o_orderpriority = '1-URGENT')::INT + (c_mktsegment = 'BUILDING')::INT + (n_regionkey < 2)::INT <= 1 THEN 'Direct' ELSE 'Indirect' END AS dependency
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def gr10_direct_indirect(spark, sf_dir):
    """crossings of logic along order, customer, nation; each hop says whether it holds logic."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("long").alias("x1"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_mktsegment") == "BUILDING").cast("long").alias("x2"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_regionkey") < 2).cast("long").alias("x3"))
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    crossings = F.col("x1") + F.col("x2") + F.col("x3")
    return met.select(_node("O", "o_orderkey").alias("root"), _node("R", "n_regionkey").alias("leaf"), crossings.alias("crossings"), X.dependency(crossings).alias("dependency"))


@query("""SELECT 'C' || c_custkey AS node, string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS labels FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL
UNION ALL SELECT 'N' || n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'R' || r_regionkey, r_name FROM region""")
def gr8_label_propagation(spark, sf_dir):
    """Region names flow back to nations and customers: every edge is a row that its source's rows lead back to."""
    r = table(spark, sf_dir, "region").select(_node("R", "r_regionkey").alias("own_key"), F.lit(None).cast("string").alias("prev_key"), F.col("r_name").alias("target_field"))
    e = _edges(spark, sf_dir, "CN")
    rows = r.unionByName(e.select(F.col("src").alias("own_key"), F.lit(None).cast("string").alias("prev_key"), F.lit("").alias("target_field")))
    labelled = graph_labels(rows, e, Scratch(spark))
    return labelled.select(F.col("own_key").alias("node"), F.col("Connectors").alias("labels"))


def graph_labels(rows: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """GR8 over edges src to dst: labels of dst rows reach src rows. Each edge is a row of its dst that leads back to src."""
    keyed = edges.select(F.col("dst").alias("own_key"), F.col("src").alias("prev_key"), F.lit("").alias("target_field")).unionByName(rows.select("own_key", "prev_key", "target_field"))
    rows = scratch.write(numbered(keyed, [F.col("target_field").desc(), F.col("own_key"), F.col("prev_key")], "edge_id", scratch, "ranged"), "numbered")
    starts = rows.where("target_field <> ''").select("own_key", F.col("target_field").alias("label"))
    # A start's label belongs to all rows of its key.
    first = rows.join(starts, "own_key").select("edge_id", "own_key", "prev_key", F.col("label").alias("target_field"))
    rest = rows.join(starts.select("own_key"), "own_key", "left_anti").select("edge_id", "own_key", "prev_key", "target_field")
    out = stitch.labels(first.unionByName(rest), scratch, F.col("target_field") != "")
    return out.where("Connectors <> ''").groupBy("own_key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("Connectors", ", "))))), ", ").alias("Connectors"))


@query(f"""WITH RECURSIVE {_EDGES}, seen AS (SELECT 'R1' AS node UNION SELECT e.src FROM seen s JOIN edges e ON e.dst = s.node) SELECT node FROM seen""")
def gr11_reachable_subgraph(spark, sf_dir):
    """All nodes that lead to region 1."""
    spark_edges = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reachable(spark.range(1).select(F.lit("R1").alias("node")), spark_edges, Scratch(spark))


@query("""SELECT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderstatus = 'F'""")
def gr16_subgraph(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(_node("C", "c_custkey").alias("node"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(_node("O", "o_orderkey").alias("node"))
    return graph.subgraph(c.unionByName(o), _edges(spark, sf_dir, "O"))


@query(f"""WITH RECURSIVE {_EDGES}, up AS (SELECT dst AS src, src AS dst FROM edges WHERE src NOT LIKE 'L%'), walk AS (
  SELECT DISTINCT src AS node, 0 AS level FROM up WHERE src NOT IN (SELECT dst FROM up)
  UNION SELECT u.dst, w.level + 1 FROM walk w JOIN up u ON u.src = w.node)
SELECT node, CAST(max(level) AS INT) AS level FROM walk GROUP BY node""")
def gr13_longest_level(spark, sf_dir):
    e = _edges(spark, sf_dir, "OCN").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.longest_levels(nodes, e, Scratch(spark))


_GROUPED = """nodes AS (SELECT 'C' || c_custkey AS node, n_name AS grp, 1 AS level FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'S' || s_suppkey, n_name, 0 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  edges AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'C' || o_custkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  crossed AS (SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS n FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.grp <> b.grp GROUP BY ALL)"""


def _grouped(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(_node("C", "c_custkey").alias("node"), F.col("n_name").alias("grp"), F.lit(1).alias("level"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(_node("S", "s_suppkey").alias("node"), F.col("n_name").alias("grp"), F.lit(0).alias("level"))
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return c.unionByName(s), li.select("l_suppkey", "o_custkey").distinct().select(_node("S", "l_suppkey").alias("src"), _node("C", "o_custkey").alias("dst"))


@query(f"WITH {_GROUPED} SELECT from_group, to_group, n FROM crossed")
def ag10_cross_counts(spark, sf_dir):
    return graph.cross_counts(*_grouped(spark, sf_dir))


@query(f"""WITH {_GROUPED} SELECT g.grp, CAST(row_number() OVER (ORDER BY g.grp = 'GERMANY', n.n_nationkey, g.grp) AS INT) AS place, g.node_count, g.level,
  CAST(coalesce((SELECT sum(n) FROM crossed WHERE to_group = g.grp), 0) AS BIGINT) AS incoming, CAST(coalesce((SELECT sum(n) FROM crossed WHERE from_group = g.grp), 0) AS BIGINT) AS outgoing
FROM (SELECT grp, count(*) AS node_count, min(level) AS level FROM nodes GROUP BY grp) g JOIN nation n ON n.n_name = g.grp""")
def gr14_panels(spark, sf_dir):
    nodes, edges = _grouped(spark, sf_dir)
    rank = table(spark, sf_dir, "nation").select(F.col("n_name").alias("grp"), F.col("n_nationkey").alias("rank"))
    return graph.panels(nodes, edges, "GERMANY", rank)


# A repository of the tables: a mapping for each nation, whose target has a field for each customer, fed by a port for each
# order, fed by a source field for each line item. Nations of region 2 and up have a second, unwired target instance;
# those of region 3 and up take their transformation from the folder. Sessions run the mappings in order of the nations.

_M = "'m' || n_nationkey"


def _tables_repo(spark: SparkSession, sf_dir: str) -> Repository:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("m"), "n_nationkey").alias("m"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "m", "n_regionkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "m", "n_regionkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    cust, orders_, line = text(F.lit("C"), "c_custkey"), text(F.lit("O"), "o_orderkey"), text(F.lit("L"), "l_orderkey", F.lit("."), "l_linenumber")
    at = [F.lit("F").alias("folder"), F.lit("MAPPING").alias("scope_kind"), F.col("m").alias("scope")]
    null = lambda kind="string": F.lit(None).cast(kind)
    attrs = F.expr("cast(map() as map<string,string>)")

    def instances(rows: DataFrame, name: str, kind: str, definition: Column, ord_: int) -> DataFrame:
        return rows.select(*at, F.lit(name).alias("instance"), F.lit(kind).alias("type"), definition.alias("transformation_name"), F.lit("Expression" if kind == "TRANSFORMATION" else "").alias("transformation_type"), F.lit(ord_).alias("ord"))

    target = text(F.lit("CUST_"), "m")
    instance = instances(n, "SRC", "SOURCE", F.lit("LINEITEM"), 0).unionByName(instances(n, "ORD", "TRANSFORMATION", F.lit("ORD"), 1)).unionByName(instances(n, "TGT", "TARGET", target, 2)).unionByName(instances(n.where("n_regionkey >= 2"), "TGT2", "TARGET", target, 3))

    def wires(rows: DataFrame, a: str, a_field: Column, a_type: str, b: str, b_field: Column, ord_: Column) -> DataFrame:
        return rows.select(*at, ord_.cast("int").alias("ord"), F.lit(a).alias("from_instance"), a_field.alias("from_field"), F.lit(a_type).alias("from_type"), F.lit(b).alias("to_instance"), b_field.alias("to_field"), F.lit("Expression").alias("to_type"))

    connector = wires(li, "SRC", line, "Source Definition", "ORD", orders_, F.col("l_linenumber")).unionByName(wires(o, "ORD", orders_, "Expression", "TGT", cust, F.col("o_orderkey")))
    shared = F.col("n_regionkey") >= 3
    held = [F.lit("F").alias("folder"), F.when(shared, "FOLDER").otherwise("MAPPING").alias("scope_kind"), F.when(shared, "").otherwise(F.col("m")).alias("scope")]
    transformation = n.select(*held, F.lit("ORD").alias("name"), F.lit("Expression").alias("type"), attrs.alias("attrs")).dropDuplicates(["folder", "scope_kind", "scope", "name"])
    port = o.select(*held, F.lit("ORD").alias("transformation"), orders_.alias("port"), F.col("o_orderkey").cast("int").alias("ord"), F.lit("INPUT/OUTPUT").alias("porttype"), F.lit("").alias("expression"), *[null().alias(x) for x in ("ref_field", "ref_instancetype", "grp")], null("int").alias("grp_pos"), *[null().alias(x) for x in ("datatype", "precision", "scale", "expression_type")], attrs.alias("attrs"))
    place = F.col("n_nationkey").cast("int")
    session = n.select(F.lit("F").alias("folder"), F.lit("wf").alias("workflow"), F.lit(0).alias("wf_ord"), F.concat(F.lit("s_"), "m").alias("session"), F.col("m").alias("mapping"), place.alias("ord"))
    task = session.select("folder", "workflow", "wf_ord", F.col("session").alias("task"), F.lit("Session").alias("tasktype"), F.col("ord"))
    pairs = n.select(F.concat(F.lit("s_m"), "n_nationkey").alias("from_task"), F.concat(F.lit("s_m"), (F.col("n_nationkey") + 1)).alias("to_task"), place.alias("ord"))
    wlink = pairs.select(F.lit("F").alias("folder"), F.lit("wf").alias("workflow"), "from_task", "to_task", F.lit("").alias("condition"), "ord")
    group = port.select(*held[:0], "folder", "scope_kind", "scope", "transformation", "grp", F.lit("").alias("grp_type"), "ord", "attrs").limit(0)
    return Repository(
        source_field=li.select(F.lit("F").alias("folder"), F.lit("LINEITEM").alias("source"), line.alias("field"), F.col("l_linenumber").cast("int").alias("ord")),
        target_field=c.select(F.lit("F").alias("folder"), target.alias("target"), cust.alias("field"), F.col("c_custkey").cast("int").alias("ord")),
        transformation=transformation, port=port, port_group=group, scope=n.select(*at, place.alias("ord")), instance=instance, connector=connector, task=task, session=session, wlink=wlink,
    )


@query(f"""WITH c AS (SELECT c_custkey, 'C' || c_custkey AS field, {_M} AS mapping, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey), li AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT mapping, 'TGT' AS instance, field, CASE WHEN l_orderkey IS NOT NULL THEN 'source' WHEN o_orderkey IS NOT NULL THEN 'literal_or_unresolved' ELSE 'unmapped' END AS leaf_type,
  'L' || l_orderkey || '.' || l_linenumber AS source_field, CASE WHEN o_orderkey IS NULL THEN '' ELSE 'ORD.O' || o_orderkey || '[Expression]' END AS chain
FROM c LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey
UNION ALL SELECT mapping, 'TGT2', field, 'unmapped', NULL, '' FROM c WHERE n_regionkey >= 2""")
def gr1_engine_trace(spark, sf_dir):
    """Every target field of every mapping through the expansion rules and the walk."""
    scratch = Scratch(spark)
    repo = cached(_tables_repo(spark, sf_dir), scratch, TRACED)
    roots = roots_of(lineage.target_fields(repo), ["folder", "scope", "instance", "field"])
    leaves = trace(roots, expansion(repo, scratch), scratch)
    return leaves.select(F.col("root.scope").alias("mapping"), "root.instance", "root.field", "leaf_type", "source_field", X.chain(F.col("hops")).alias("chain"))


@query(f"""SELECT {_M} AS mapping, 'CUST_' || {_M} AS tbl, 'C' || c_custkey AS field, CASE WHEN n_regionkey >= 2 THEN 'TGT, TGT2' ELSE 'TGT' END AS instances, CASE WHEN n_regionkey >= 2 THEN 'Yes' ELSE 'No' END AS multi FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def gr21_engine_write_sets(spark, sf_dir):
    """Also J7: whether a table's field is written by several instances."""
    writes, _ = stitch.read_write_sets(_tables_repo(spark, sf_dir))
    return writes.select("mapping", F.col("table").alias("tbl"), "field", F.array_join("instances", ", ").alias("instances"), F.when(F.size("instances") > 1, "Yes").otherwise("No").alias("multi"))


@query(f"""SELECT {_M} AS mapping, CASE WHEN n_regionkey >= 3 THEN 'FOLDER' ELSE 'MAPPING' END AS found_in, 'Expression' AS ttype FROM nation""")
def j2_engine_definition(spark, sf_dir):
    repo = _tables_repo(spark, sf_dir)
    rows = resolve.with_definition(repo.instance.where("instance = 'ORD'"), repo, "transformation_name")
    return rows.select(F.col("scope").alias("mapping"), F.col("d_kind").alias("found_in"), F.col("d_type").alias("ttype"))


def _asked(repo: Repository) -> DataFrame:
    return repo.instance.where("type = 'TARGET'").select("folder", F.col("scope").alias("mapping"), "instance").distinct()


@query(f"""SELECT {_M} AS mapping, t AS instance FROM nation, (VALUES ('TGT'), ('TGT2')) v(t) WHERE t = 'TGT' OR n_regionkey >= 2""")
def pf3_target_instances(spark, sf_dir):
    repo = _tables_repo(spark, sf_dir)
    asked = repo.scope.select(F.col("scope").alias("mapping"), F.lower(F.concat(F.lit(" Cust_"), "scope")).alias("table"))
    return report.target_instances(repo.instance, asked).select("mapping", "instance")


@query(f"""SELECT DISTINCT {_M} AS mapping, 'TGT' AS instance, 'ORD' AS producer FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def pf7_producers(spark, sf_dir):
    repo = _tables_repo(spark, sf_dir)
    return report.producers_of(repo.connector, _asked(repo)).select("mapping", "instance", "producer")


@query(f"""SELECT {_M} AS mapping, t AS instance, 'C' || c_custkey AS field FROM customer JOIN nation ON n_nationkey = c_nationkey, (VALUES ('TGT'), ('TGT2')) v(t) WHERE t = 'TGT' OR n_regionkey >= 2""")
def pf8_instance_fields(spark, sf_dir):
    repo = _tables_repo(spark, sf_dir)
    return report.instance_fields(repo.instance, repo.target_field, _asked(repo)).select("mapping", "instance", "field")


@query(f"""WITH n AS (SELECT {_M} AS mapping, 's_' || {_M} AS session, n_nationkey, n_regionkey FROM nation), w AS (SELECT DISTINCT c_nationkey, 'C' || c_custkey AS field FROM customer JOIN orders ON o_custkey = c_custkey),
 a AS (SELECT *, '' AS instance FROM n UNION ALL SELECT *, 'TGT' FROM n UNION ALL SELECT *, 'NONE' FROM n),
 s AS (SELECT *, CASE WHEN instance = 'NONE' THEN 'wrong instance' WHEN instance = '' AND n_regionkey >= 2 THEN 'ambiguous table' ELSE 'ready' END AS state FROM a)
SELECT mapping, instance, state, CASE WHEN state = 'ready' THEN session END AS session, field FROM s LEFT JOIN w ON w.c_nationkey = s.n_nationkey AND s.state = 'ready'""")
def cq8_listing(spark, sf_dir):
    scratch = Scratch(spark)
    repo = _tables_repo(spark, sf_dir)
    names = F.explode(F.array(F.lit(""), F.lit("TGT"), F.lit("NONE")))
    asked = repo.scope.select(F.col("scope").alias("mapping"), F.concat(F.lit("cust_"), "scope").alias("table"), names.alias("instance"))
    rows = report.listing(repo.instance, repo.target_field, repo.connector, order.session_order(repo, scratch), asked, scratch)
    return rows.select("mapping", "instance", "state", "session", "field")


@query(f"""WITH t AS (SELECT 's_' || {_M} AS id, n_nationkey AS k FROM nation) SELECT 'node' AS part, id AS a, id AS b, 'Session' AS c FROM t
UNION ALL SELECT 'edge', x.id, y.id, '' FROM t x JOIN t y ON y.k = x.k + 1""")
def gr15_overview(spark, sf_dir):
    repo = _tables_repo(spark, sf_dir)
    nodes, edges = graph.overview(repo.task, repo.wlink)
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("kind").alias("c")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("label").alias("c")))


@query(f"""WITH n AS (SELECT {_M} AS scope, n_nationkey, n_regionkey FROM nation), i AS (SELECT scope, id, CASE id WHEN 'SRC' THEN 'LINEITEM' WHEN 'ORD' THEN 'ORD' ELSE 'CUST_' || scope END AS label, CASE id WHEN 'SRC' THEN 'SOURCE' WHEN 'ORD' THEN 'TRANSFORMATION' ELSE 'TARGET' END AS kind
  FROM n, (VALUES ('SRC'), ('ORD'), ('TGT'), ('TGT2')) v(id) WHERE id <> 'TGT2' OR n_regionkey >= 2), w AS (SELECT scope, o_orderkey FROM n JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)
SELECT scope, 'node' AS part, id AS a, label AS b, kind AS c FROM i UNION ALL SELECT DISTINCT scope, 'edge', 'ORD', 'TGT', '' FROM w UNION ALL SELECT DISTINCT scope, 'edge', 'SRC', 'ORD', '' FROM w JOIN lineitem ON l_orderkey = o_orderkey""")
def cq10_canvas(spark, sf_dir):
    repo = _tables_repo(spark, sf_dir)
    nodes, edges = graph.canvas(repo.instance, repo.connector)
    return nodes.select("scope", F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("kind").alias("c")).unionByName(edges.select("scope", F.lit("edge").alias("part"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("label").alias("c")))


@query("""SELECT 'orders' AS what, count(*) AS n FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'open orders', count(*) FROM orders WHERE o_orderstatus = 'O'""")
def ag9_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return report.counts(**{"orders": o, "customers": table(spark, sf_dir, "customer"), "open orders": o.where("o_orderstatus = 'O'")})


# As-of joins and read/write sets.


def _asof(spark, sf_dir, before: bool) -> DataFrame:
    e = table(spark, sf_dir, "events")
    writers = e.where("event_type in ('purchase', 'signup')").select("user_id", "event_id", "event_type")
    readers = e.where("event_type in ('view', 'click')").select("user_id", F.col("event_id").alias("at"))
    found = stitch.closest(readers, writers, ["user_id"], "at", "event_id", before, ["event_type"], "found_")
    return found.select("user_id", "at", "found_event_id", "found_event_type")


def _asof_sql(before: bool) -> str:
    pick, cmp = ("max", "<") if before else ("min", ">")
    return f"""WITH w AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')),
  r AS (SELECT user_id, event_id AS at FROM events WHERE event_type IN ('view', 'click')),
  f AS (SELECT r.user_id, r.at, {pick}(w.event_id) AS found_event_id FROM r LEFT JOIN w ON w.user_id = r.user_id AND w.event_id {cmp} r.at GROUP BY ALL)
SELECT f.user_id, f.at, f.found_event_id, w.event_type AS found_event_type FROM f LEFT JOIN w ON w.event_id = f.found_event_id AND w.user_id = f.user_id"""


@query(_asof_sql(True))
def j5_prev_writer(spark, sf_dir):
    return _asof(spark, sf_dir, True)


@query(_asof_sql(False))
def j6_next_reader(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@query("""SELECT l_partkey AS tbl, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'Yes' ELSE 'No' END AS multi, string_agg(DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 6, '0'), ', ' ORDER BY lpad(CAST(l_suppkey AS VARCHAR), 6, '0')) AS instances FROM lineitem GROUP BY l_partkey""")
def j7_multi_instance(spark, sf_dir):
    names = F.array_sort(F.collect_set(F.lpad(F.col("l_suppkey").cast("string"), 6, "0")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("tbl")).agg(names.alias("names"))
    return rows.select("tbl", F.when(F.size("names") > 1, "Yes").otherwise("No").alias("multi"), F.array_join("names", ", ").alias("instances"))


@query("""SELECT o_orderpriority AS tbl, l_returnflag AS field, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS instances FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def gr21_rw_sets(spark, sf_dir):
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy(F.col("o_orderpriority").alias("tbl"), F.col("l_returnflag").alias("field")).agg(F.array_join(F.array_sort(F.collect_set("l_linestatus")), ", ").alias("instances"))


@query("""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 's:' || d.lang) AS found FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def j2_local_then_folder(spark, sf_dir):
    local = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(local, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.concat(F.lit("s:"), "lang")).alias("found"))


@query("""WITH cat AS (SELECT p_brand, p_type, p_size, p_name, p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 49)),
 t1 AS (SELECT p_brand, p_type, p_size, arg_min(p_name, p_partkey) AS v FROM cat GROUP BY ALL), t2 AS (SELECT p_brand, p_type, arg_min(p_name, p_partkey) AS v FROM cat GROUP BY ALL), t3 AS (SELECT p_brand, arg_min(p_name, p_partkey) AS v FROM cat GROUP BY ALL)
SELECT p.p_partkey, coalesce(t1.v, t2.v, t3.v) AS p_name, CASE WHEN t1.v IS NOT NULL THEN 1 WHEN t2.v IS NOT NULL THEN 2 WHEN t3.v IS NOT NULL THEN 3 ELSE 0 END AS tier
FROM part p LEFT JOIN t1 USING (p_brand, p_type, p_size) LEFT JOIN t2 USING (p_brand, p_type) LEFT JOIN t3 USING (p_brand)""")
def j14_three_tier_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    found = report.tiered_match(p.select("p_partkey", "p_brand", "p_type", "p_size"), p.join(returned, "p_partkey", "left_semi"), [["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_brand"]], "p_name", "p_partkey")
    return found.select("p_partkey", "p_name", "tier")


# Scalar functions.

_EXPRESSIONS = [
    (1, "IIF(X > 0, X, :LKP.LKP_C(Y))"), (2, "v_a || LTRIM(RTRIM(b_2))"), (3, "SYSDATE"), (4, ""), (5, ":lkp.one(A, B) + :LKP.two( C )"), (6, "'STATUS' = STATUS AND max_x"),
]
#: The literal rows and the texts of all documents.
_TEXTS = f"(SELECT id, e FROM {_values(_EXPRESSIONS, 'id, e')} UNION ALL SELECT 1000 + doc_id, coalesce(text, '') FROM documents)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, _EXPRESSIONS, "id long, e string")
    return rows.unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.coalesce("text", F.lit("")).alias("e")))


_UPPER = ", ".join(f"'{k}'" for k in X.KEYWORDS)


@query(f"""SELECT id, CAST(pos AS INT) AS pos, tok FROM (SELECT id, tok, row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS pos FROM (
  SELECT id, tok, min(i) AS first FROM (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT id, regexp_extract_all(e, '[A-Za-z_][A-Za-z0-9_]*') AS toks FROM {_TEXTS})) WHERE upper(tok) NOT IN ({_UPPER}) GROUP BY id, tok))""")
def f1_tokens(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.posexplode(X.tokens(F.col("e"))).alias("pos", "tok"))


@query("""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS INT) AS n FROM documents""")
def f1_token_counts(spark, sf_dir):
    found = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.TOKEN), F.lit(0))))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("n"))


@query(f"""SELECT id, unnest(regexp_extract_all(e, '(?i):LKP\\.(\\w+)\\s*\\(([^)]*)\\)', 1)) AS name, unnest(regexp_extract_all(e, '(?i):LKP\\.(\\w+)\\s*\\(([^)]*)\\)', 2)) AS args FROM {_TEXTS}""")
def f2_lkp_calls(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.explode(X.lookup_calls(F.col("e"))).alias("c")).select("id", "c.name", "c.args")


_NAMES = [("X",), ("b_2",), ("b",), ("STATUS",), ("Y",)]


@query(f"""SELECT id, name FROM {_TEXTS} t, (SELECT * FROM {_values(_NAMES, 'name')}) n WHERE regexp_matches(e, '(^|[^\\p{{L}}\\p{{N}}_])' || name || '([^\\p{{L}}\\p{{N}}_]|$)')""")
def f3_whole_word(spark, sf_dir):
    """Word boundaries are those of Unicode, which the SQL has to spell out."""
    e, n = _texts(spark, sf_dir), _rows(spark, _NAMES, "name string")
    return e.join(F.broadcast(n), X.names_whole_word(F.col("e"), F.col("name"))).select("id", "name")


@query("""SELECT doc_id, CASE WHEN length(e) > 70 THEN left(e, 67) || '...' ELSE e END AS shown FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g')) AS e FROM documents)""")
def lt4_short(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.short(F.col("text")).alias("shown"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, string_agg(event_type, ' -> ' ORDER BY event_id) AS runs FROM s WHERE p IS NULL OR p <> event_type GROUP BY user_id""")
def f5_hop_grouping(spark, sf_dir):
    hops = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: X.hop(e["event_type"], F.lit("t"), F.lit(""), e["event_type"]))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(hops.alias("hops"))
    return rows.select("user_id", F.array_join(F.transform(X.grouped_hops(F.col("hops")), lambda h: h["name"]), " -> ").alias("runs"))


@query("""WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, string_agg(role || '.' || turn || '[turn]', ' -> ' ORDER BY turn DESC) AS chain FROM s WHERE p IS NULL OR p <> role GROUP BY conv_id""")
def f6_chain_string(spark, sf_dir):
    hops = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda e: X.hop(e["role"], F.lit("turn"), e["turn"].cast("string"), e["role"]))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(hops.alias("hops"))
    return rows.select("conv_id", X.chain(F.col("hops")).alias("chain"))


# Grouping, windows, pages and filters.

_ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"""SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k = 1""")
def ag1_dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_ALL.split(", "))
    return report.keep_first(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in _ALL.split(", ")[2:]])


@query("""SELECT l_partkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_partkey""")
def ag7_sorted_join(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("flags"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, place, CASE WHEN place > 300 THEN n - 300 ELSE 0 END AS omitted FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)) WHERE place <= 301""")
def lt2_cap_with_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    return graph.capped_groups(rows, "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 300)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
def lt3_page(spark, sf_dir):
    return report.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), [F.col("o_orderkey")], 4)


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high')""")
def pf9_text_filter(spark, sf_dir):
    return report.text_filter(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "HIGH", ["o_orderpriority", "o_orderstatus"])


_ALLOWED = {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def pf10_value_filter(spark, sf_dir):
    return report.value_filter(table(spark, sf_dir, "orders"), _ALLOWED).select("o_orderkey")


@query("SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def pf11_cascade(spark, sf_dir):
    return report.cascade(table(spark, sf_dir, "orders"), "o_orderstatus", _ALLOWED)


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def pf6_wired(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return report.wired_fields(table(spark, sf_dir, "part"), lines, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT n_name AS id, regexp_replace('N_' || n_name || '_' || n_nationkey, '[^A-Za-z0-9_-]', '_', 'g') AS clean FROM nation")
def f16_clean_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), X.clean_id(F.lit("N"), F.col("n_name"), F.col("n_nationkey").cast("string")).alias("clean"))


from fieldweave.operators import dependency_queries, flow_queries, mapplet_queries, repository_queries  # noqa: E402, F401  (they register their queries and need the names above)
