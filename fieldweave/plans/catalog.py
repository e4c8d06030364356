"""Catalogs of transformations (Tab-2), of mapplets' paths (Tab-3) and of mapplets' transformations (Tab-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.expressions import business_logic, category, chain, grouped_hops, port_class, tokens
from fieldweave.operators.closure import first_visits
from fieldweave.operators.expand import expansion
from fieldweave.operators.resolve import boundary_ports, instance_ports, port_map, resolved_instances
from fieldweave.operators.trace import roots_of, trace
from fieldweave.scratch import Scratch
from fieldweave.sources.repository import SCOPE, Repository

# Column names of the shown tables.
DISPLAY = ["Transformation Name", "PORT_NAME", "Transformation Type", "Business Logic", "Additional Informations", "Category", "Input Ports", "Output Ports", "Custom / Variable Ports"]
MAPPLET_DISPLAY = [
    "Mapping_Name", "Mapplet_name", "Input Transformation Field", "Transformation_lineage", "Output Transformation Field", "Upstream HOP/Prev_Transformation_name",
    "Upstream_HOP/Prev_Transformation_attribute", "Downstream_HOP/Next_Transformation_name", "Downstream_HOP/next_Transformation_attribute",
]
# Fixed values end.
OWNER = [*SCOPE, "instance"]


def transformation_catalog(repo: Repository, scratch: Scratch, scope_kind: str = "MAPPING") -> DataFrame:
    """CQ2 (MAPPING) and CQ3 (MAPPLET): one row an instance and port that isn't a plain input.

    The port's expression closure inside the transformation gives its input, output and variable ports and, dependencies
    first, its logic. Adds _Mapping or Mapplet_Name and _Mapplet, and _Port. Equal rows are one; sorted when shown.
    """
    inst = scratch.write(resolved_instances(repo), f"instances-{scope_kind}")
    ports = instance_ports(inst, repo).where((F.col("scope_kind") == scope_kind) & (F.col("type") == "TRANSFORMATION"))
    kept = [*OWNER, "transformation_type", "d_attrs", F.col("p_port").alias("port"), F.col("p_porttype").alias("porttype"), F.col("p_expression").alias("expr"), F.col("p_attrs").alias("port_attrs"), F.col("p_grp").alias("grp"), "d_kind", "d_scope", "transformation_name"]
    ports = scratch.write(ports.select(*kept, port_class(F.col("p_port"), F.col("p_porttype"), F.col("p_expression")).alias("class")), f"ports-{scope_kind}")
    key = [*OWNER, "port"]
    is_root = F.expr("class.is_out or class.is_var or not class.is_in")
    # Written, so that the walk doesn't find them anew each round, and that few names are broadcast to the ports.
    named = scratch.write(ports.where("expr <> ''").select(*key, F.posexplode(tokens(F.col("expr"))).alias("ord", "next_port")), f"named-{scope_kind}")
    edges = named.join(ports.select(*OWNER, F.col("port").alias("next_port")), [*OWNER, "next_port"])
    edges = scratch.write(edges.select(*key, *[F.col(c).alias(f"next_{c}") for c in OWNER], "next_port", "ord"), f"edges-{scope_kind}")
    # Ports that name no other reach themselves alone, so only the rest are walked; a walk stays in its instance.
    walked = ports.where(is_root).join(edges.select(*key).distinct(), key, "left_semi")
    visits = first_visits(walked.select(F.col("port").alias("root"), *key), edges, key, scratch, f"closure-{scope_kind}")
    reached = visits.where("port <> root").join(ports.select(*key, "expr", "class"), key)
    blank = F.col("expr") == ""
    is_out, is_in, is_var = (F.col(f"class.{c}") for c in ("is_out", "is_in", "is_var"))

    def shown_as(own: bool) -> tuple[Column, Column, Column]:
        """Whether a port is listed as input, output and variable, of itself (own) or of a port that reaches it."""
        as_out = is_out & F.lit(own)
        as_var = ~as_out & (is_var | is_out)
        return (~as_out & ~as_var & is_in & blank) | (blank & is_out & is_in), as_out, as_var

    line = lambda path: F.when(~blank, F.struct(path.alias("path"), F.concat("port", F.lit(" = "), "expr").alias("line")))
    as_in, _, as_var = shown_as(own=False)
    far = reached.groupBy(*OWNER, "root").agg(F.collect_set(F.when(as_in, F.col("port"))).alias("far_in"), F.collect_set(F.when(as_var, F.col("port"))).alias("far_var"), F.collect_list(line(F.col("path"))).alias("far_lines"))
    as_in, as_out, as_var = shown_as(own=True)
    # Rows that aren't shown bring their name and kind alone.
    wide = ["transformation_type", "d_attrs", "expr", "port_attrs", "grp", "d_kind", "d_scope", "transformation_name"]
    own = ports.select(*key, *[F.when(is_root, F.col(c)).alias(c) for c in wide], is_root.alias("is_root"), as_in.alias("own_in"), as_out.alias("own_out"), as_var.alias("own_var"), line(F.expr("cast(array() as array<bigint>)")).alias("own_line"))
    # One shuffle by the name of a port brings together its rows and what it reaches.
    rows = own.unionByName(far.withColumnRenamed("root", "port"), allowMissingColumns=True).dropna(subset=key)
    w = Window.partitionBy(*key[::-1])
    over = lambda **c: [v.over(w).alias(k) for k, v in c.items()]
    found = over(in_=F.bool_or("own_in"), out=F.bool_or("own_out"), var=F.bool_or("own_var"), all_in=F.max("far_in"), all_var=F.max("far_var"), all_lines=F.max("far_lines"), own_lines=F.collect_list("own_line"), n_roots=F.count_if("is_root"))
    rows = rows.select(*key, *wide, "is_root", *found).where("is_root")
    none = F.expr("cast(array() as array<string>)")
    itself = lambda side: F.when(F.col(side), F.array("port")).otherwise(none)
    listed = lambda names: F.array_join(F.array_sort(names), ", ")
    ins, vars_ = F.concat(F.coalesce("all_in", none), itself("in_")), F.concat(F.coalesce("all_var", none), itself("var"))
    # A port's own lines count once for each row that asks for them.
    own_lines = F.flatten(F.array_repeat("own_lines", F.col("n_roots").cast("int")))
    lines = F.coalesce(F.concat("all_lines", own_lines), own_lines)
    closure = F.array_join(F.transform(F.reverse(F.array_sort(lines)), lambda x: x["line"]), "\n")
    rows = rows.select(*key, *wide, listed(ins).alias("Input Ports"), listed(itself("out")).alias("Output Ports"), listed(vars_).alias("Custom / Variable Ports"), closure.alias("closure"))
    g = repo.port_group.select(*[F.col(c).alias(f"g_{c}") for c in SCOPE], F.col("transformation").alias("g_name"), F.col("grp").alias("g_grp"), F.col("attrs").alias("grp_attrs"))
    rows = rows.join(g, [F.col("folder") == F.col("g_folder"), F.col("d_kind") == F.col("g_scope_kind"), F.col("d_scope") == F.col("g_scope"), F.col("transformation_name") == F.col("g_name"), F.col("grp") == F.col("g_grp")], "left")
    logic, more = business_logic(F.col("transformation_type"), F.col("d_attrs"), F.col("port_attrs"), F.col("grp"), F.col("grp_attrs"), F.col("closure"))
    out = rows.select(F.col("instance").alias("Transformation Name"), F.col("port").alias("PORT_NAME"), F.coalesce("transformation_type", F.lit("")).alias("Transformation Type"), logic.alias("Business Logic"), more.alias("Additional Informations"), category(F.col("expr")).alias("Category"), "Input Ports", "Output Ports", "Custom / Variable Ports", F.col("scope").alias("_Mapping"))
    # What only repeats a column is added after, so rows are told apart by fewer.
    out = out.dropDuplicates().withColumn("_Port", F.col("PORT_NAME"))
    if scope_kind == "MAPPLET":
        out = out.withColumnRenamed("_Mapping", "_Mapplet").withColumn("Mapplet_Name", F.col("_Mapplet"))
    return out


def shown(catalog: DataFrame) -> DataFrame:
    """AG3, SO2: display columns alone; of rows that look equal the first by name, scope and port; sorted."""
    scope = "_Mapping" if "_Mapping" in catalog.columns else "_Mapplet"
    display = [*(["Mapplet_Name"] if scope == "_Mapplet" else []), *DISPLAY]
    order = ["Transformation Name", scope, "_Port"]
    w = Window.partitionBy(*[f"`{c}`" for c in display]).orderBy(*order)
    return catalog.select("*", F.row_number().over(w).alias("_k")).where("_k = 1").orderBy(*order).select(*[f"`{c}`" for c in display])


def mapplet_catalog(repo: Repository, scratch: Scratch, steps: DataFrame | None = None) -> DataFrame:
    """CQ4: mapping, mapplet instance, output port and each inner path that reaches the mapplet's input boundary.

    Upstream and downstream are the first connectors of the mapping at the mapplet's exposed ports.
    """
    # Written, so that few instances are broadcast and their very many ports are not dealt by so few names.
    inst = scratch.write(resolved_instances(repo), "catalog-instances")
    out = boundary_ports(instance_ports(inst, repo), "output")
    roots = out.select("folder", F.lit("MAPPLET").alias("scope_kind"), F.col("mapplet").alias("scope"), "instance", F.col("port").alias("field"))
    leaves = trace(roots_of(roots, ["folder", "scope", "instance", "field"]), steps if steps is not None else expansion(repo, scratch), scratch, "mapplet-trace").where("leaf_type = 'scope_input_boundary'")
    maps = port_map(repo)
    exposed = lambda side: maps.where(F.col("boundary") == side).groupBy(F.col("folder").alias("x_folder"), F.col("mapplet").alias("x_mapplet"), F.col("internal").alias("x_internal")).agg(F.max("exposed").alias(f"{side}_exposed"))
    rows = leaves.select("root.*", "hops", "ord_path", "boundary_instance", "boundary_field").withColumnsRenamed({"scope": "mapplet", "instance": "out_instance", "field": "out_field"})
    for side, name in (("output", "out_field"), ("input", "boundary_field")):
        rows = rows.join(exposed(side), [F.col("folder") == F.col("x_folder"), F.col("mapplet") == F.col("x_mapplet"), F.col(name) == F.col("x_internal")], "left").drop("x_folder", "x_mapplet", "x_internal")
    rows = rows.select("*", F.coalesce("output_exposed", "out_field").alias("out_shown"), F.coalesce("input_exposed", "boundary_field").alias("in_shown"))
    uses = inst.where("scope_kind = 'MAPPING' and is_mapplet").select("folder", F.col("scope").alias("mapping"), "instance", F.col("transformation_name").alias("mapplet"))
    rows = uses.join(rows, ["folder", "mapplet"])
    c = repo.connector.where("scope_kind = 'MAPPING'")
    up = c.groupBy("folder", F.col("scope").alias("mapping"), F.col("to_instance").alias("instance"), F.col("to_field").alias("in_shown")).agg(F.min_by(F.struct(F.col("from_instance").alias("name"), F.col("from_field").alias("field"), F.coalesce("from_type", F.lit("")).alias("type")), "ord").alias("up"))
    down = c.groupBy("folder", F.col("scope").alias("mapping"), F.col("from_instance").alias("instance"), F.col("from_field").alias("out_shown")).agg(F.min_by(F.struct(F.col("to_instance").alias("name"), F.col("to_field").alias("field"), F.coalesce("to_type", F.lit("")).alias("type")), "ord").alias("down"))
    rows = rows.join(up, ["folder", "mapping", "instance", "in_shown"], "left").join(down, ["folder", "mapping", "instance", "out_shown"], "left")
    step = lambda h: F.concat(h["name"], F.lit("."), h["field"], F.lit("["), h["type"], F.lit("]"))
    ends = lambda name, field, kind: F.struct(name.alias("name"), kind.alias("type"), field.alias("field"), F.lit(None).cast("string").alias("mapping"), F.col("mapplet").alias("mapplet"), F.lit("mapplet").alias("scope"))
    outer = lambda h: F.when(h.isNotNull(), F.struct(h["name"].alias("name"), h["type"].alias("type"), h["field"].alias("field"), F.col("mapping").alias("mapping"), F.lit(None).cast("string").alias("mapplet"), F.lit("mapping").alias("scope")))
    own = F.transform(F.reverse(grouped_hops(F.col("hops"))), lambda h: ends(h["name"], h["field"], h["type"]))
    first = F.array(ends(F.col("boundary_instance"), F.col("boundary_field"), F.lit("Input Transformation")))
    hops = F.concat(F.array(outer(F.col("up"))), F.when(F.size("hops") > 0, own).otherwise(first), F.array(ends(F.col("out_instance"), F.col("out_field"), F.lit("Output Transformation")), outer(F.col("down"))))
    middle = F.when(F.size("hops") > 0, chain(F.col("hops"))).otherwise(F.concat("boundary_instance", F.lit("."), "boundary_field", F.lit("[Input Transformation]")))
    path = F.concat_ws(" -> ", step(F.col("up")), middle, F.concat("out_instance", F.lit("."), "out_field", F.lit("[Output Transformation]")), step(F.col("down")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    columns = [F.col("mapping"), F.col("mapplet"), F.col("in_shown"), path, F.col("out_shown"), blank("up.name"), blank("up.field"), blank("down.name"), blank("down.field")]
    table = rows.select(*[c.alias(n) for c, n in zip(columns, MAPPLET_DISPLAY, strict=True)], F.col("instance").alias("_Mapplet_Instance"), F.to_json(F.filter(hops, lambda h: h.isNotNull())).alias("_Transformation_lineage_data"), "ord_path")
    w = Window.partitionBy(*[f"`{c}`" for c in MAPPLET_DISPLAY], "_Mapplet_Instance").orderBy("ord_path")
    return table.select("*", F.row_number().over(w).alias("_k")).where("_k = 1").drop("_k", "ord_path")
