"""Queries over report tables: filters, cascades, pages, matches with fallbacks, name resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.scratch import Scratch


def text_filter(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """PF9: rows with a column that holds the text, case ignored."""
    hits = [F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(text.lower())) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def value_filter(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """PF10: rows whose value is allowed in every named column."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isin(v) for c, v in allowed.items()], F.lit(True)))


def cascade(df: DataFrame, column: str, allowed: dict[str, list]) -> DataFrame:
    """PF11: the column's distinct values among rows that pass all other filters, sorted."""
    return value_filter(df, {c: v for c, v in allowed.items() if c != column}).select(column).distinct().orderBy(column)


def page(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """LT3: page `number` from 1, held within the pages there are. The one count is of rows, made by Spark."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def tiered_match(rows: DataFrame, catalog: DataFrame, tiers: list[list[str]], value: str, order: str) -> DataFrame:
    """The value of the first catalog row that matches on the first tier's columns, else the next tier's, and so on.

    Each tier is reduced to one row a key before its join, so no join multiplies rows.
    """
    found = rows
    for k, keys in enumerate(tiers):
        tier = catalog.groupBy(*[F.col(c).alias(f"_t{k}_{c}") for c in keys]).agg(F.min_by(value, order).alias(f"_v{k}"))
        found = found.join(tier, [found[c] == tier[f"_t{k}_{c}"] for c in keys], "left").drop(*[f"_t{k}_{c}" for c in keys])
    tier_no = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(k + 1)) for k in range(len(tiers))], F.lit(0))
    return found.select(*rows.columns, F.coalesce(*[f"_v{k}" for k in range(len(tiers))]).alias(value), tier_no.alias("tier"))


def resolve_identifier(names: DataFrame, mappings: DataFrame, sessions: DataFrame, workflows: DataFrame) -> DataFrame:
    """PF4: name, mapping: by mapping, session, workflow exactly, then the same without case; the first kind that fits.

    `mappings`: mapping; `sessions`: session, mapping; `workflows`: workflow, mapping.
    """
    known = mappings.select(F.col("mapping").alias("key"), "mapping", F.lit(1).alias("p")).unionByName(sessions.select(F.col("session").alias("key"), "mapping", F.lit(2).alias("p"))).unionByName(workflows.select(F.col("workflow").alias("key"), "mapping", F.lit(3).alias("p")))
    exact = names.join(known, names.name == known.key).select("name", "mapping", "p")
    loose = names.join(known, F.lower(names.name) == F.lower(known.key)).select("name", "mapping", (F.col("p") + 3).alias("p"))
    found = exact.unionByName(loose)
    best = F.rank().over(Window.partitionBy("name").orderBy("p"))
    return found.select("*", best.alias("k")).where("k = 1").select("name", "mapping").distinct()


def first_session(order: DataFrame) -> DataFrame:
    """PF5: mapping, session: the first session in execution order that runs it."""
    return order.groupBy("folder", "mapping").agg(F.min_by("session", "exec_order").alias("session"))


def target_instances(instances: DataFrame, asked: DataFrame) -> DataFrame:
    """PF3: folder, mapping, table, instance: TARGET instances of the asked mappings and tables; table names compare without case."""
    a = asked.select(F.col("mapping").alias("a_mapping"), "table", F.lower(F.trim("table")).alias("a_table")).distinct()
    targets = instances.where("scope_kind = 'MAPPING' and type = 'TARGET'")
    return targets.join(a, [targets["scope"] == a["a_mapping"], F.lower("transformation_name") == F.col("a_table")]).select("folder", F.col("scope").alias("mapping"), "table", "instance", "ord")


def producers_of(connectors: DataFrame, asked: DataFrame) -> DataFrame:
    """PF7: folder, mapping, instance, producer: distinct instances wired straight to each asked one (folder, mapping, instance)."""
    wires = connectors.where("scope_kind = 'MAPPING'").select("folder", F.col("scope").alias("mapping"), F.col("to_instance").alias("instance"), F.col("from_instance").alias("producer"))
    return wires.join(asked.select("folder", "mapping", "instance").distinct(), ["folder", "mapping", "instance"], "left_semi").distinct()


def instance_fields(instances: DataFrame, target_fields: DataFrame, asked: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """PF8: folder, mapping, instance, field, ord: target fields of each asked instance: of the first TARGET instance of the
    name, else of the first of any type whose definition is a target. With a scratch the instances are written first."""
    named = instances.where("scope_kind = 'MAPPING'").select("folder", F.col("scope").alias("mapping"), "instance", "transformation_name", (F.coalesce("type", F.lit("")) != "TARGET").alias("other"), F.col("ord").alias("i_ord"))
    named = named.join(asked.select("folder", "mapping", "instance").distinct(), ["folder", "mapping", "instance"], "left_semi")
    first = named.groupBy("folder", "mapping", "instance").agg(F.min(F.struct("other", "i_ord", "transformation_name")).alias("first"))
    found = first.select("folder", "mapping", "instance", F.col("first.transformation_name").alias("target"))
    found = found if scratch is None else scratch.write(found, "listing-instances")
    return found.join(target_fields, ["folder", "target"]).select("folder", "mapping", "instance", "field", "ord")


#: Names of chosen instances up to which they are told to the plan as values.
TOLD = 1000


def listing(instances: DataFrame, target_fields: DataFrame, connectors: DataFrame, order: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """CQ8: asked columns and state; for `ready` ones also the session, and a row for each field that is wired: field and ord.

    `asked`: mapping, table, instance (blank: the table's only one). States are form_state's. Requests and wired fields are
    written, so that few requests are broadcast to very many fields, and these are not dealt by so few names.
    """
    mappings = instances.where("scope_kind = 'MAPPING'").select(F.col("scope").alias("mapping")).distinct()
    targets = instances.where("scope_kind = 'MAPPING' and type = 'TARGET'").select(F.col("scope").alias("mapping"), "instance", F.col("transformation_name").alias("table"))
    state = form_state(mappings, targets, asked)
    chosen = target_instances(instances, state.where("state = 'ready'")).select("folder", F.col("mapping").alias("c_mapping"), F.col("table").alias("c_table"), F.col("instance").alias("chosen"))
    same = [F.col("mapping") == F.col("c_mapping"), F.col("table") == F.col("c_table"), (F.trim(F.coalesce("instance", F.lit(""))) == "") | (F.col("instance") == F.col("chosen"))]
    met = state.join(chosen, [(F.col("state") == "ready"), *same], "left").select(*asked.columns, "state", "folder", "chosen")
    session = first_session(order).select(F.col("folder").alias("s_folder"), F.col("mapping").alias("s_mapping"), "session")
    met = scratch.write(met.join(session, [F.col("folder") == F.col("s_folder"), F.col("mapping") == F.col("s_mapping")], "left").drop("s_folder", "s_mapping"), "listing-requests")
    fields = instance_fields(instances, target_fields, met.where("chosen is not null").select("folder", "mapping", F.col("chosen").alias("instance")), scratch)
    # Wires to other instances need not be made where the chosen ones' names are few.
    names = [r[0] for r in met.where("chosen is not null").select("chosen").distinct().limit(TOLD + 1).collect()]
    if len(names) <= TOLD:
        connectors = connectors.where(F.col("to_instance").isin(names))
    wires = connectors.where("scope_kind = 'MAPPING'").select("folder", F.col("scope").alias("mapping"), F.col("to_instance").alias("instance"), F.col("to_field").alias("field"))
    fields = wired_fields(fields, wires, ["folder", "mapping", "instance", "field"]).select(F.col("folder").alias("f_folder"), F.col("mapping").alias("f_mapping"), F.col("instance").alias("f_instance"), "field", "ord")
    fields = scratch.write(fields, "listing-fields")
    same = [F.col("folder") == F.col("f_folder"), F.col("mapping") == F.col("f_mapping"), F.col("chosen") == F.col("f_instance")]
    # A left join keeps its left side from being broadcast, so requests without fields are added apart.
    columns = [*asked.columns, "state", "session", "field", "ord"]
    without = met.join(scratch.write(fields.select("f_folder", "f_mapping", "f_instance").distinct(), "listing-wired"), same, "left_anti")
    none = [F.lit(None).cast(fields.schema[c].dataType).alias(c) for c in ("field", "ord")]
    return fields.join(met, same).select(*columns).unionByName(without.select(*columns[:-2], *none))


def wired_fields(fields: DataFrame, connectors: DataFrame, keys: list[str]) -> DataFrame:
    """PF6: fields that a connector leads to."""
    return fields.join(connectors.select(*keys).distinct(), keys, "left_semi")


def form_state(mappings: DataFrame, instances: DataFrame, asked: DataFrame) -> DataFrame:
    """PF14, CQ8: state of each request (mapping, table, instance): the first check that fails, or `ready`.

    `mappings`: mapping; `instances`: mapping, instance, table of TARGET instances. Table names compare without case.
    """
    by_table = instances.groupBy("mapping", F.lower("table").alias("t")).agg(F.count_distinct("instance").alias("n"), F.collect_set("instance").alias("names"))
    a = asked.join(mappings.select("mapping", F.lit(True).alias("known")).distinct(), "mapping", "left").withColumn("t", F.lower(F.col("table")))
    a = a.join(by_table, ["mapping", "t"], "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    state = (
        F.when(blank("mapping") | blank("table"), "blank").when(F.col("known").isNull(), "unknown mapping").when(F.col("n").isNull(), "table is no target")
        .when(~blank("instance") & ~F.array_contains("names", F.col("instance")), "wrong instance").when(blank("instance") & (F.col("n") > 1), "ambiguous table").otherwise("ready")
    )
    return a.select(*asked.columns, state.alias("state"))


def counts(**tables: DataFrame) -> DataFrame:
    """AG9: what, n: the number of rows of each table given by name."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """AG1, AG3: the first row of each key."""
    return rows.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_k")).where("_k = 1").drop("_k")


def suffix_matches(outputs: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Output and input ports of one transformation where one is the other and digits; never both with a suffix.

    Two equi-joins, one a direction. `outputs`: keys, out; `inputs`: keys, inp.
    """
    stem = lambda c: F.regexp_extract(c, r"^(.*?)(\d+)$", 1)
    suffixed = lambda c: F.col(c).rlike(r"^.*?\d+$")
    fan_in = outputs.withColumn("stem", F.col("out")).join(inputs.where(suffixed("inp")).withColumn("stem", stem("inp")), [*keys, "stem"])
    fan_out = outputs.where(suffixed("out")).withColumn("stem", stem("out")).join(inputs.withColumn("stem", F.col("inp")), [*keys, "stem"])
    columns = [*keys, "out", "inp"]
    return fan_in.select(*columns, F.lit("fan-in").alias("kind")).unionByName(fan_out.select(*columns, F.lit("fan-out").alias("kind"))).where("out <> inp")


def node_detail(nodes: DataFrame) -> DataFrame:
    """CQ11: the lines a node's panel shows, by kind."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    kinds = {"SOURCE": ("session", "mapping", "instance", "table", "field", "source_qualifier"), "TARGET": ("session", "mapping", "instance", "table", "field"), "TRANSFORMATION": ("mapping", "instance", "field", "ttype", "logic"), "MAPPLET": ("mapping", "instance", "field", "logic")}
    text = None
    for kind, columns in kinds.items():
        value = F.concat_ws("\n", *[line(c, c) for c in columns if c in nodes.columns])
        when = F.col("kind").startswith(kind)
        text = F.when(when, value) if text is None else text.when(when, value)
    return nodes.select("id", "kind", text.alias("detail"))
