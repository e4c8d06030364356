"""Registered queries of router, normalizer and update strategy over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.operators import flows
from fieldweave.operators.queries import query
from fieldweave.tables import table


@query("""WITH r AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' END, CASE WHEN o_totalprice >= 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL)) AS grp FROM orders)
SELECT o_orderkey, grp FROM r UNION ALL SELECT o_orderkey, 'DEFAULT' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)""")
def flow_router(spark, sf_dir):
    """Orders by three groups that overlap; those of none under the default group."""
    groups = {"urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "large": F.col("o_totalprice") >= 200_000, "open": F.col("o_orderstatus") == "O"}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return flows.route(rows, groups, "grp").select("o_orderkey", "grp")


@query("""SELECT l_orderkey, l_linenumber, 1 AS gcid, 'ship' AS kind, l_shipdate AS day, CAST(l_quantity AS DOUBLE) AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 2, 'cost', NULL, CAST(l_extendedprice AS DOUBLE) FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3, NULL, NULL, CAST(l_tax AS DOUBLE) FROM lineitem WHERE l_tax > 0.02""")
def flow_normalizer(spark, sf_dir):
    """Three occurrences of three repeated columns a line item; where all three are null there is no row."""
    none = lambda kind: F.lit(None).cast(kind)
    columns = [F.lit("ship").alias("kind_1"), F.lit("cost").alias("kind_2"), none("string").alias("kind_3"), F.col("l_shipdate").alias("day_1"), none("timestamp").alias("day_2"), none("timestamp").alias("day_3")]
    amounts = [F.col("l_quantity").alias("amount_1"), F.col("l_extendedprice").alias("amount_2"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("amount_3")]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns, *amounts)
    out = flows.normalize(li, ["l_orderkey", "l_linenumber"], {c: [f"{c}_{k}" for k in (1, 2, 3)] for c in ("kind", "day", "amount")})
    return out.drop("gk")


_CHANGED = """ch AS (SELECT user_id AS c_custkey, event_type AS c_mktsegment, value AS c_acctbal, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 3 END AS flag FROM events),
  r AS (SELECT c_custkey, c_mktsegment, c_acctbal, event_id, flag, 1 AS side FROM ch WHERE flag < 3 AND c_custkey IS NOT NULL UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, NULL, 0, 0 FROM customer),
  t AS (SELECT *, last_value(CASE flag WHEN 0 THEN true WHEN 2 THEN false END IGNORE NULLS) OVER (PARTITION BY c_custkey ORDER BY side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM r),
  a AS (SELECT *, CASE WHEN flag = 0 THEN NOT coalesce(there, false) ELSE coalesce(there, false) END AS applies FROM t)"""


def _changes(spark, sf_dir):
    flag = F.when(F.col("event_type") == "signup", flows.INSERT).when(F.col("event_type") == "purchase", flows.UPDATE).when(F.col("event_type") == "error", flows.DELETE).otherwise(flows.REJECT)
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), F.col("value").alias("c_acctbal"), "event_id", flag.alias("flag"))
    held = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return flows.apply_changes(held, changes, ["c_custkey"], "flag", [F.col("event_id")])


@query(f"WITH {_CHANGED}, z AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY side DESC, event_id DESC) AS k FROM a WHERE applies) SELECT c_custkey, c_mktsegment, c_acctbal FROM z WHERE k = 1 AND flag <> 2")
def flow_update_strategy(spark, sf_dir):
    """Customers after the events of their key: signups insert, purchases update, errors delete."""
    return _changes(spark, sf_dir)[0]


@query(f"""WITH {_CHANGED} SELECT event_id, CASE flag WHEN 0 THEN 'present' ELSE 'absent' END AS reason FROM a WHERE NOT applies
UNION ALL SELECT event_id, CASE WHEN flag = 3 THEN 'flagged' ELSE 'no key' END FROM ch WHERE flag = 3 OR c_custkey IS NULL""")
def flow_update_rejects(spark, sf_dir):
    return _changes(spark, sf_dir)[1].select("event_id", "reason")
