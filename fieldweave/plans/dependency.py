"""Direct and indirect dependencies of target fields, hop by hop or flat, and the graph of one attribute.

Here instances are told apart by name and type, a port's expression names other ports as whole words, and every port is
visited once a root: the walk is depth-first with one visited set, so a second arrival is a marker row. The walk is found
breadth-wise by relaxation: a port keeps the least path of step ordinals and passes it on when it improves (see closure).

Two deliberate differences from a walk by names: ports of a mapplet are told apart by where it was entered, so a second
instance of one mapplet is no cycle; and exposed port names are translated to internal ones and back.

A walk goes 60 hops. An arrival beyond ends in a row that says so, before it is asked whether its port was visited, and
counts as wired for the port it comes from. Graphs show no port beyond the limit. Where the limit cuts, a port may hold a
path whose earlier part was found to be another since; such ports are taken back and found again until all hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.expressions import dependency, instance_kind, names_whole_word, node_id
from fieldweave.operators import graph
from fieldweave.operators.closure import first_visits
from fieldweave.operators.order import session_order
from fieldweave.operators.report import first_session, suffix_matches
from fieldweave.operators.resolve import boundary_ports, instance_ports, port_map, resolved_instances, with_definition
from fieldweave.scratch import Scratch, numbered
from fieldweave.sources.repository import SCOPE, Repository, cached

MAX_HOPS = 60
REFERENCES, HOP_DIGITS = 1_000_000_000, 1000
STACK = "array<struct<scope_kind:string,scope:string,instance:string>>"
HOPS = "array<struct<instance:string,field:string,ttype:string,logic:string,label:string>>"
PLACE = [*SCOPE, "instance", "itype", "field"]
# Texts of output rows.
NO_UPSTREAM = "(no upstream connector -- literal, mapping parameter/variable, Sequence Generator value, or unconnected port)"
TRUNCATED = "Maximum lineage depth reached; trace truncated to avoid a runaway loop."
CYCLE = "Cycle detected -- this exact field was already visited earlier in the trace."
INPUT_NOTE = "(input port -- value received as-is from the upstream connector)"
PASS_NOTE = "(pass-through / no port-level expression captured for this port)"
BEST_EFFORT = "[Best-effort: this Custom Transformation's internal port mapping isn't captured in the exported metadata, so every connected input port is shown as a possible source.]"
# Fixed values end.


def crossing(ttype: Column, field: Column, expr: Column, refs: Column, first_is_variable: Column, attrs: Column, expression_type: Column) -> Column:
    """whether a port holds logic of its own rather than passing a value through."""
    t, e = F.lower(F.coalesce(ttype, F.lit(""))), F.trim(F.coalesce(expr, F.lit("")))
    first = F.coalesce(F.get(refs, F.lit(0)), F.lit(""))
    bare = (F.size(refs) == 1) & (e == first)
    generic = (F.size(refs) > 0) & ~bare
    told = lambda name: F.trim(F.coalesce(attrs.getItem(name), F.lit(""))) != ""
    looked = F.concat_ws(" ", attrs.getItem("Lookup condition"), attrs.getItem("Lookup Sql Override"))
    return (
        F.when(t.contains("expression"), F.when((e == "") | (e == field), False).when(bare, first_is_variable).otherwise(True))
        .when(t.contains("source qualifier"), told("Sql Query"))
        .when(t == "filter", told("Filter Condition"))
        .when(t.contains("aggregator"), (F.upper(F.coalesce(expression_type, F.lit(""))) == "GROUPBY") | generic)
        .when(t.contains("lookup"), ((F.trim(looked) != "") & names_whole_word(F.lower(looked), F.lower(field))) | generic)
        .otherwise(generic)
    )


@dataclass
class Flow:
    """What a walk needs, for every port at once."""

    nodes: DataFrame  # PLACE, table, ttype, logic, is_crossing, entry_instance, entry_field
    edges: DataFrame  # SCOPE, instance, itype, field, ord, to_instance, to_itype, to_field
    back: DataFrame  # folder, mapplet, internal, exposed: input ports of mapplets


def flow(repo: Repository, scratch: Scratch) -> Flow:
    inst = resolved_instances(repo)
    every = with_definition(repo.instance, repo, "transformation_name").select(*SCOPE, "instance", F.col("type").alias("itype"), "transformation_name", "transformation_type", "ord", "d_kind", "d_scope", "d_type", "d_attrs")
    exact = Window.partitionBy(*SCOPE, "instance", "itype").orderBy(F.col("ord").desc())
    every = scratch.write(every.select("*", F.row_number().over(exact).alias("_k")).where("_k = 1").drop("_k"), "flow-instances")
    by_name = every.groupBy(*SCOPE, "instance").agg(F.max_by("itype", "ord").alias("last_type"))

    # A connector's ends by name and type, else by name.
    c = repo.connector.select(*SCOPE, "ord", F.col("to_instance").alias("instance"), F.col("to_field").alias("field"), F.col("from_instance").alias("to_instance"), F.col("from_field").alias("to_field"), F.when(F.col("from_type").isNotNull(), instance_kind(F.col("from_type"))).alias("hint"))
    typed = every.select(*SCOPE, F.col("instance").alias("to_instance"), F.col("itype").alias("hint"), F.col("itype").alias("exact"))
    named = by_name.select(*SCOPE, F.col("instance").alias("to_instance"), "last_type")
    wires = c.join(typed, [*SCOPE, "to_instance", "hint"], "left").join(named, [*SCOPE, "to_instance"], "left")
    wires = scratch.write(wires.select(*SCOPE, "instance", "field", "ord", "to_instance", F.coalesce("exact", "last_type", F.lit("MISSING")).alias("to_itype"), "to_field"), "flow-wires")

    # Ports of transformations: roles, expressions, the ports an expression names (longest names first).
    ports = instance_ports(every.where("itype = 'TRANSFORMATION'"), repo).select(*SCOPE, "instance", "transformation_type", "d_type", "d_attrs", F.col("p_port").alias("field"), F.col("p_ord").alias("p_ord"), F.upper("p_porttype").alias("role"), F.col("p_expression").alias("expr"), F.col("p_expression_type").alias("expression_type"))
    ports = scratch.write(ports, "flow-ports")
    inputs = ports.where("role like '%INPUT%' or role like '%VARIABLE%'").select(*SCOPE, "instance", F.col("field").alias("ref"), F.col("p_ord").alias("r_ord"), (F.col("role").contains("VARIABLE")).alias("r_var"))
    refs = ports.where("expr <> ''").join(inputs, [*SCOPE, "instance"]).where((F.col("ref") != F.col("field")) & names_whole_word(F.col("expr"), F.col("ref")))
    refs = scratch.write(refs.select(*SCOPE, "instance", "field", "ref", "r_var", F.row_number().over(Window.partitionBy(*SCOPE, "instance", "field").orderBy(F.length("ref").desc(), "r_var", "r_ord")).alias("k")), "flow-refs")
    listed = refs.groupBy(*SCOPE, "instance", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ref"))), lambda x: x["ref"]).alias("refs"), F.min_by("r_var", "k").alias("first_var"))

    # A port with neither connector nor reference: group variants by name, else all inputs of a custom transformation.
    bare = ports.join(wires.select(*SCOPE, "instance", "field").distinct(), [*SCOPE, "instance", "field"], "left_anti").join(refs.select(*SCOPE, "instance", "field").distinct(), [*SCOPE, "instance", "field"], "left_anti")
    wired_inputs = ports.where("role like '%INPUT%'").select(*SCOPE, "instance", F.col("field").alias("inp"), F.col("p_ord").alias("i_ord"))
    variant = suffix_matches(bare.select(*SCOPE, "instance", F.col("field").alias("out")), wired_inputs.drop("i_ord"), [*SCOPE, "instance"]).select(*SCOPE, "instance", F.col("out").alias("field"), "inp").distinct().join(wired_inputs, [*SCOPE, "instance", "inp"])
    source = wires.select(*SCOPE, "instance", F.col("field").alias("inp"), F.col("ord").alias("w_ord"), "to_instance", "to_itype", "to_field")
    variant = variant.join(source, [*SCOPE, "instance", "inp"])
    is_custom = F.lower(F.coalesce("transformation_type", "d_type", F.lit(""))).contains("custom")
    opaque = bare.where(is_custom).join(variant.select(*SCOPE, "instance", "field").distinct(), [*SCOPE, "instance", "field"], "left_anti").select(*SCOPE, "instance", "field").join(wired_inputs, [*SCOPE, "instance"]).join(source, [*SCOPE, "instance", "inp"])
    place = F.row_number().over(Window.partitionBy(*SCOPE, "instance", "field").orderBy("i_ord", "w_ord")).cast("long")
    fallback = lambda df: df.select(*SCOPE, "instance", "field", place.alias("ord"), "to_instance", "to_itype", "to_field")
    edges = wires.select(*SCOPE, "instance", F.lit(None).cast("string").alias("only"), "field", F.col("ord").cast("long").alias("ord"), "to_instance", "to_itype", "to_field")
    inner = refs.select(*SCOPE, "instance", F.lit("TRANSFORMATION").alias("only"), "field", (F.lit(REFERENCES) + F.col("k")).alias("ord"), F.col("instance").alias("to_instance"), F.lit("TRANSFORMATION").alias("to_itype"), F.col("ref").alias("to_field"))
    edges = edges.unionByName(inner)
    for more in (variant, opaque):
        edges = edges.unionByName(fallback(more).withColumn("only", F.lit("TRANSFORMATION")))

    t_of = F.coalesce("transformation_type", F.nullif("d_type", F.lit("")), F.lit("(unknown)"))
    told = ports.join(listed, [*SCOPE, "instance", "field"], "left").join(opaque.select(*SCOPE, "instance", "field").distinct().withColumn("opaque", F.lit(True)), [*SCOPE, "instance", "field"], "left")
    none = F.expr("cast(array() as array<string>)")
    plain_in = F.col("role").contains("INPUT") & ~F.col("role").contains("OUTPUT")
    logic = F.when(F.col("expr") != "", F.col("expr")).when(plain_in, INPUT_NOTE).otherwise(PASS_NOTE)
    logic = F.when(F.col("opaque").isNotNull(), F.concat_ws(" ", F.nullif(logic, F.lit("")), F.lit(BEST_EFFORT))).otherwise(logic)
    told = told.select(*SCOPE, "instance", "field", logic.alias("logic"), (crossing(t_of, F.col("field"), F.col("expr"), F.coalesce("refs", none), F.coalesce("first_var", F.lit(False)), F.col("d_attrs"), F.col("expression_type")) | F.lit(False)).alias("is_crossing"))

    # Places: ends of connectors and ports.
    seen = wires.select(*SCOPE, F.col("to_instance").alias("instance"), F.col("to_itype").alias("itype"), F.col("to_field").alias("field")).union(ports.select(*SCOPE, "instance", F.lit("TRANSFORMATION"), "field")).distinct()
    maps = port_map(repo)
    outs = boundary_ports(instance_ports(inst, repo), "output").select("folder", F.col("mapplet").alias("transformation_name"), F.col("port").alias("entry_field"), F.col("instance").alias("entry_instance"))
    # an instance of the mapplet that has the output port, one whose type says output first.
    any_out = instance_ports(inst.where("scope_kind = 'MAPPLET'"), repo).where("upper(p_porttype) like '%OUTPUT%'").groupBy("folder", F.col("scope").alias("transformation_name"), F.col("p_port").alias("entry_field")).agg(F.min_by("instance", F.struct((~F.lower(F.coalesce("transformation_type", "d_type", F.lit(""))).contains("output")).alias("x"), "ord")).alias("any_instance"))
    nodes = seen.join(every.select(*SCOPE, "instance", "itype", "transformation_name", t_of.alias("ttype")), [*SCOPE, "instance", "itype"], "left")
    nodes = nodes.join(maps.where("boundary <> 'input'").select("folder", F.col("mapplet").alias("transformation_name"), F.col("exposed").alias("field"), "internal"), ["folder", "transformation_name", "field"], "left")
    nodes = nodes.withColumn("entry_field", F.when(F.col("itype") == "MAPPLET", F.coalesce("internal", "field"))).join(outs, ["folder", "transformation_name", "entry_field"], "left").join(any_out, ["folder", "transformation_name", "entry_field"], "left")
    # Without references told is a scan of the ports, whose file says too little of their rows: Spark would broadcast them all.
    nodes = nodes.join(told.hint("merge"), [*SCOPE, "instance", "field"], "left")
    nodes = nodes.select(*PLACE, F.col("transformation_name").alias("table"), F.coalesce("ttype", F.lit("(unknown)")).alias("ttype"), F.coalesce("logic", F.lit(PASS_NOTE)).alias("logic"), F.coalesce("is_crossing", F.lit(False)).alias("is_crossing"), F.coalesce("entry_instance", "any_instance").alias("entry_instance"), "entry_field")
    back = maps.where("boundary = 'input'").groupBy("folder", F.col("mapplet").alias("scope"), F.col("internal").alias("field")).agg(F.max("exposed").alias("exposed"))
    return Flow(scratch.write(nodes, "flow-nodes"), scratch.write(edges, "flow-edges"), scratch.write(back, "flow-back"))


@dataclass
class Walk:
    states: DataFrame  # every visited place of a root, with its least path: STATE columns and the node's own
    markers: DataFrame  # arrivals at a place already visited: STATE columns
    cut: DataFrame  # arrivals beyond the limit: STATE columns
    links: DataFrame  # root, parent, child, style, shown: steps taken, places as ids; not shown: into a port beyond the limit or one still open


STATE = ["root", "stack", *PLACE, "path", "hops", "crossing", "hop", "mapplet", "parent"]


def _place_key() -> Column:
    return F.concat_ws("\x1f", F.array_join(F.transform("stack", lambda s: F.concat_ws("/", s["scope"], s["instance"])), "|"), *PLACE)


def _identity() -> Column:
    """A place's id in graphs: kind, scope, instance and field, as in every other table."""
    return node_id(F.lower("scope_kind"), F.col("scope"), F.col("instance"), F.col("field"))


def _children(states: DataFrame, f: Flow, outward: bool = True) -> DataFrame:
    """States one step further; `states` hold their node's columns. `outward`: whether walks go on behind a mapplet's input."""
    on = [*SCOPE, "instance", "field"]
    e = f.edges.select(*[F.col(c).alias(f"e_{c}") for c in f.edges.columns])
    at = lambda c: F.col(f"e_{c}")
    hop = F.struct("instance", "field", "ttype", "logic", F.concat("instance", F.lit("."), "field").alias("label"))
    grown = F.array_append("hops", hop).cast(HOPS)
    own = states.where("itype not in ('SOURCE', 'MAPPLET', 'MISSING')")
    met = own.join(e, [F.col(c) == at(c) for c in on] + [at("only").isNull() | (at("only") == F.col("itype"))], "left")
    said = F.col("crossing") + F.col("is_crossing").cast("int")
    style = F.when(at("only").isNotNull() & (at("ord") > REFERENCES), "logic").when(F.col("itype") == "TARGET", "flow").when(F.col("is_crossing"), "logic").otherwise("passthrough")
    go = met.where(at("ord").isNotNull()).select("root", "stack", *SCOPE, at("to_instance").alias("instance"), at("to_itype").alias("itype"), at("to_field").alias("field"), F.array_append("path", at("ord")).alias("path"), F.when(F.col("itype") == "TARGET", F.col("hops")).otherwise(grown).alias("hops"), F.when(F.col("itype") == "TARGET", F.col("crossing")).otherwise(said).alias("crossing"), (F.col("hop") + 1).alias("hop"), "mapplet", _identity().alias("parent"), style.alias("style"))
    # Into a mapplet.
    inside = states.where("itype = 'MAPPLET' and entry_instance is not null")
    mark = F.struct(F.col("table").alias("instance"), "field", F.lit("Mapplet").alias("ttype"), F.concat(F.lit("Enters Mapplet '"), "table", F.lit("' via its output port '"), "field", F.lit("'.")).alias("logic"), F.concat("instance", F.lit("."), "field").alias("label"))
    enter = inside.select("root", F.array_append("stack", F.struct("scope_kind", "scope", "instance")).alias("stack"), "folder", F.lit("MAPPLET").alias("scope_kind"), F.col("table").alias("scope"), F.col("entry_instance").alias("instance"), F.lit("TRANSFORMATION").alias("itype"), F.col("entry_field").alias("field"), F.array_append("path", F.lit(0).cast("long")).alias("path"), F.array_append("hops", mark).cast(HOPS).alias("hops"), "crossing", (F.col("hop") + 1).alias("hop"), F.col("table").alias("mapplet"), _identity().alias("parent"), F.lit("flow").alias("style"))
    if not outward:
        return go.unionByName(enter).select(*STATE, "style")
    # Out of one, where its input boundary has no connector: what feeds the instance one level up.
    out = met.where(at("ord").isNull() & (F.size("stack") > 0)).drop(*[f"e_{c}" for c in f.edges.columns]).join(f.back, ["folder", "scope", "field"], "left")
    top = F.element_at("stack", -1)
    out = out.select("root", F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"), "folder", top["scope_kind"].alias("scope_kind"), top["scope"].alias("scope"), top["instance"].alias("instance"), F.coalesce("exposed", "field").alias("field"), "path", grown.alias("hops"), "crossing", "hop", "mapplet", _identity().alias("parent"), F.when(F.col("is_crossing"), "logic").otherwise("passthrough").alias("style"))
    out = out.join(e.where("e_only is null"), [F.col(c) == at(c) for c in on])
    out = out.select("root", "stack", *SCOPE, at("to_instance").alias("instance"), at("to_itype").alias("itype"), at("to_field").alias("field"), F.array_append("path", at("ord")).alias("path"), "hops", "crossing", (F.col("hop") + 1).alias("hop"), "mapplet", "parent", "style")
    return go.unionByName(enter).unionByName(out).select(*STATE, "style")


def walk(roots: DataFrame, f: Flow, scratch: Scratch, name: str, max_hops: int = MAX_HOPS, outward: bool = True) -> Walk:
    """GR9 and GR10's traversal of every root (columns root, SCOPE, instance, field: target fields) at once.

    `roots` may have a column hop, at which their walks start.
    """
    start = roots.select("root", F.expr(f"cast(array() as {STACK})").alias("stack"), *SCOPE, "instance", F.lit("TARGET").alias("itype"), "field", F.expr("cast(array() as array<bigint>)").alias("path"), F.expr(f"cast(array() as {HOPS})").alias("hops"), F.lit(0).alias("crossing"), (F.col("hop") if "hop" in roots.columns else F.lit(0)).alias("hop"), F.lit("").alias("mapplet"), F.lit("").alias("parent"))

    def full(states: DataFrame) -> DataFrame:
        return states.join(f.nodes, PLACE, "left").select(*STATE, "table", F.coalesce("ttype", F.lit("Target")).alias("ttype"), F.coalesce("logic", F.lit(PASS_NOTE)).alias("logic"), F.coalesce("is_crossing", F.lit(False)).alias("is_crossing"), "entry_instance", "entry_field")

    best = scratch.write(start.select("*", _place_key().alias("key")), f"{name}-best0")
    front, step = best, 0
    while True:
        while not front.isEmpty():
            step += 1
            met = _children(full(front.drop("key")), f, outward).where(F.col("hop") <= max_hops).drop("style").select("*", _place_key().alias("key"))
            met = met.select("*", F.row_number().over(Window.partitionBy("root", "key").orderBy("path")).alias("_k")).where("_k = 1").drop("_k")
            known = best.select("root", "key", F.col("path").alias("old"))
            front = scratch.write(met.join(known, ["root", "key"], "left").where("old is null or path < old").drop("old"), f"{name}-front{step}")
            if not front.isEmpty():
                best = scratch.write(best.join(front.select("root", "key"), ["root", "key"], "left_anti").unionByName(front), f"{name}-best{step}")
        states = scratch.write(full(best.drop("key")), f"{name}-states{step}")
        arrivals = scratch.write(_children(states, f, outward).select("*", _place_key().alias("key")), f"{name}-arrivals{step}")
        if arrivals.where(F.col("hop") > max_hops).isEmpty():
            break
        lost = scratch.write(best.where(F.size("path") > 0).join(arrivals.select("root", "key", "path"), ["root", "key", "path"], "left_anti").select("root", "key"), f"{name}-lost{step}")
        if lost.isEmpty():
            break
        step += 1
        best = scratch.write(best.join(lost, ["root", "key"], "left_anti"), f"{name}-best{step}")
        front = best
    known = best.select("root", "key", F.col("path").alias("old"))
    told = arrivals.join(known, ["root", "key"], "left")
    cut = told.where(F.col("hop") > max_hops).select(*STATE)
    markers = told.where((F.col("hop") <= max_hops) & (F.col("path") != F.col("old"))).select(*STATE)
    # No edge leads into a port beyond the limit, nor back into one that is still open when the walk comes to it again.
    within = (F.size("old") <= F.size("path")) & (F.slice("path", F.lit(1), F.size("old")) == F.col("old")) & (F.col("old") != F.col("path"))
    shown = F.max(F.coalesce(~within, F.col("hop") <= max_hops)).alias("shown")
    links = told.groupBy("root", "parent", _identity().alias("child"), "style").agg(shown)
    return Walk(states, markers, cut, links)


def target_roots(repo: Repository) -> DataFrame:
    """Every field of every TARGET instance of the mappings, keyed by root (folder, mapping, instance, field), with its table and places."""
    inst = repo.instance.where("type = 'TARGET' and scope_kind = 'MAPPING'").select(*SCOPE, "instance", F.col("transformation_name").alias("target"), F.col("ord").alias("inst_ord"))
    fields = repo.target_field.select("folder", "target", "field", F.col("ord").alias("field_ord"))
    rows = inst.join(fields, ["folder", "target"])
    maps = repo.scope.where("scope_kind = 'MAPPING'").select("folder", "scope", F.col("ord").alias("map_ord"))
    rows = rows.join(maps, ["folder", "scope"])
    return rows.select(F.struct("folder", F.col("scope").alias("mapping"), "instance", "field").alias("root"), *SCOPE, "instance", "field", "target", "map_ord", "inst_ord", "field_ord")


def _leaves(w: Walk, f: Flow) -> DataFrame:
    """Ends of a walk: path, hops, crossing, hop, source table and field where there is one, note."""
    wired = w.links.select("root", "parent").distinct()
    own = w.states.where("itype not in ('SOURCE', 'MAPPLET', 'MISSING')").withColumn("me", _identity())
    dead = own.join(wired, (own.root == wired.root) & (own.me == wired.parent), "left_anti").select(*own.columns)
    hop = F.struct("instance", "field", "ttype", "logic", F.concat("instance", F.lit("."), "field").alias("label"))
    none = F.lit(None).cast("string")
    row = lambda df, hops, table, field, note, mapplet=F.col("mapplet"): df.select("root", "path", hops.alias("hops"), "crossing", "hop", mapplet.alias("mapplet"), table.alias("source_table"), field.alias("source_field"), note.alias("note"))
    out = row(w.states.where("itype = 'SOURCE'"), F.col("hops"), F.col("table"), F.col("field"), F.lit(""))
    out = out.unionByName(row(w.states.where("itype = 'MISSING'"), F.col("hops"), none, none, F.lit("Referenced instance not found; trace stopped.")))
    stuck = F.concat(F.lit("Mapplet boundary '"), "table", F.lit("' could not be resolved to an internal producing port; trace stops here."))
    out = out.unionByName(row(w.states.where("itype = 'MAPPLET' and entry_instance is null"), F.col("hops"), none, none, stuck, F.col("table")))
    out = out.unionByName(row(dead.where("itype <> 'TARGET' or size(path) > 0"), F.array_append("hops", hop).cast(HOPS), none, none, F.lit(NO_UPSTREAM)))
    out = out.unionByName(row(dead.where("itype = 'TARGET' and size(path) = 0"), F.col("hops"), none, none, F.lit("No inbound connector found for this target field.")))
    out = out.unionByName(row(w.cut, F.col("hops"), none, none, F.lit(TRUNCATED)))
    return out.unionByName(row(w.markers, F.col("hops"), none, none, F.lit(CYCLE)))


def producers(repo: Repository, order: DataFrame | None = None) -> DataFrame:
    """J10 (declaration order) and J11 (execution order first): folder, mapping, table, field_key, and the root that writes it in another mapping."""
    t = target_roots(repo).select("folder", F.col("scope").alias("up_mapping"), F.col("target").alias("table"), F.lower("field").alias("field_key"), F.col("root").alias("up_root"), "map_ord", "inst_ord", "field_ord")
    if order is None:
        t = t.withColumn("rank", F.lit(0))
    else:
        first = order.groupBy("folder", F.col("mapping").alias("up_mapping")).agg(F.min("exec_order").alias("rank"))
        t = t.join(first, ["folder", "up_mapping"], "left").withColumn("rank", F.coalesce("rank", F.lit(2**31 - 1)))
    # The two best mappings of each field are enough: one of them is another than the reader's.
    best = F.dense_rank().over(Window.partitionBy("folder", "table", "field_key").orderBy("rank", "map_ord"))
    one = F.row_number().over(Window.partitionBy("folder", "table", "field_key", "up_mapping").orderBy("inst_ord", "field_ord"))
    return t.select("*", best.alias("place"), one.alias("first")).where("place <= 2 and first = 1").select("folder", "table", "field_key", "up_mapping", "up_root", "place")


@dataclass
class Run:
    """What a report over several mappings needs besides its walks."""

    flow: Flow
    roots: DataFrame  # of target_roots
    start: DataFrame  # root, target, root_place: where the report begins, numbered in its order
    ranked: DataFrame  # the same of all roots
    session: DataFrame  # s_folder, s_mapping, session: the first session of a mapping


def _run(repo: Repository, scratch: Scratch, name: str, mapping: str | None, instance: str | None) -> Run:
    f = flow(repo, scratch)
    order = scratch.write(session_order(repo, scratch), "flow-sessions")
    roots = scratch.write(target_roots(repo), "flow-roots")
    first = order.groupBy("folder", F.col("mapping").alias("scope")).agg(F.min("exec_order").alias("exec"))
    declared = [F.col("exec").asc_nulls_last(), F.col("map_ord"), F.col("inst_ord"), F.col("field_ord")]
    ranked = numbered(roots.join(first, ["folder", "scope"], "left").select("root", "target", "exec", "map_ord", "inst_ord", "field_ord"), declared, "root_place", scratch, f"{name}-ranged")
    ranked = start = scratch.write(ranked.select("root", "target", "root_place"), f"{name}-ranked")
    if mapping is not None:
        start = start.where(F.col("root.mapping") == mapping)
    if instance is not None:
        start = start.where(F.col("root.instance") == instance)
    session = first_session(order).select(F.col("folder").alias("s_folder"), F.col("mapping").alias("s_mapping"), "session")
    return Run(f, roots, start, ranked, session)


def _followed(ends: DataFrame, run: Run, repo: Repository, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Which reads of other mappings' targets a report follows: each (mapping, table, field) once, where it is first met.

    `ends`: root, leaf_place, hop, source_table, source_field. Returns (seen, reads). seen: read, up_root, run_path, added:
    a walk that the report shows, with its place and the hops before it; reads: root, leaf_place, hop, read, reader, table,
    field_key of every end with a table.
    """
    reads = ends.where("source_table is not null").select("root", "leaf_place", "hop", F.concat_ws("\x1f", "root.mapping", "source_table", F.lower("source_field")).alias("read"), F.col("root.folder").alias("folder"), F.col("root.mapping").alias("reader"), F.col("source_table").alias("table"), F.lower("source_field").alias("field_key"))
    writer = reads.select("read", "folder", "reader", "table", "field_key").distinct().join(producers(repo), ["folder", "table", "field_key"]).where("reader <> up_mapping")
    writer = scratch.write(writer.select("read", "up_root", F.row_number().over(Window.partitionBy("read").orderBy("place")).alias("_k")).where("_k = 1").drop("_k"), f"{name}-writers")
    # First visits over reads, hops packed below the ordinals.
    step = lambda c: (c * HOP_DIGITS + F.col("hop")).cast("long")
    inner = writer.join(reads.select(F.col("root").alias("up_root"), F.col("read").alias("next_read"), step(F.col("leaf_place")).alias("ord")), "up_root").join(writer.select(F.col("read").alias("next_read")), "next_read", "left_semi")
    heads = run.start.select(F.concat(F.lit("\x1e"), F.to_json("root")).alias("read"), F.col("root").alias("up_root"), "root_place")
    outer = heads.join(reads.select(F.col("root").alias("up_root"), F.col("read").alias("next_read"), step(F.col("leaf_place")).alias("ord")), "up_root").join(writer.select(F.col("read").alias("next_read")), "next_read", "left_semi").select("read", "next_read", "ord")
    top = heads.select(F.lit("run").alias("read"), F.col("read").alias("next_read"), (F.col("root_place") * HOP_DIGITS).cast("long").alias("ord"))
    edges = scratch.write(top.unionByName(outer).unionByName(inner.select("read", "next_read", "ord")), f"{name}-reads")
    visits = first_visits(heads.limit(1).select(F.lit(0).alias("root"), F.lit("run").alias("read")), edges, ["read"], scratch, f"{name}-visits")
    added = F.aggregate("path", F.lit(0).cast("long"), lambda s, x: s + x % HOP_DIGITS)
    visits = visits.where("read <> 'run'").select("read", F.col("path").alias("run_path"), added.cast("int").alias("added"))
    # Likewise a union of two tables.
    seen = visits.join(heads.select("read", "up_root").unionByName(writer.select("read", "up_root")).hint("merge"), "read")
    return seen, reads


def flat_lineage(repo: Repository, scratch: Scratch, mapping: str | None = None, instance: str | None = None, max_hops: int = MAX_HOPS) -> DataFrame:
    """GR10, GR18 to GR20, CQ6 and CQ7: one row a target field and leaf, with upstream sessions' rows behind it.

    Rows that come from another session's target have the hops before it added and a link. A walk ends at `max_hops` with
    a row that says so.
    """
    repo = cached(repo, scratch)
    run = _run(repo, scratch, "flat", mapping, instance)
    leaves = _leaves(walk(run.roots, run.flow, scratch, "flat", max_hops), run.flow)
    rank = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    placed = scratch.write(leaves.select("*", rank.alias("leaf_place")), "flat-numbered")
    seen, reads = _followed(placed, run, repo, scratch, "flat")
    ranked, session = run.ranked, run.session
    rows = seen.join(placed.withColumnRenamed("root", "up_root"), "up_root").join(ranked.select(F.col("root").alias("up_root"), "target"), "up_root")
    rows = rows.join(session, [rows.up_root.folder == session.s_folder, rows.up_root.mapping == session.s_mapping], "left")
    reader = reads.select(F.col("read").alias("x"), "reader", "table", "field_key").distinct()
    by = session.select(F.col("s_mapping").alias("reader"), F.col("session").alias("reader_session"))
    rows = rows.join(reader, rows.read == reader.x, "left").join(by, "reader", "left")
    last = lambda c: F.col(f"up_root.{c}")
    link = F.when(F.col("x").isNotNull(), F.concat(F.coalesce("session", last("mapping")), F.lit("."), "target", F.lit("."), last("field"), F.lit(" -> "), F.coalesce("reader_session", "reader"), F.lit("."), "table", F.lit("."), "field_key")).otherwise(F.lit(""))
    shown = F.reverse("hops")
    ends = F.concat(F.when(F.col("source_table").isNotNull(), F.array(F.concat("source_table", F.lit("."), "source_field"))).otherwise(F.array().cast("array<string>")), F.transform(shown, lambda h: h["label"]), F.array(F.concat(last("instance"), F.lit("."), last("field"))))
    told = F.concat(F.transform(shown, lambda h: F.concat(h["instance"], F.lit(" ("), h["ttype"], F.lit("): "), h["logic"])), F.when(F.col("note") != "", F.array("note")).otherwise(F.array().cast("array<string>")))
    nearest = F.try_element_at("hops", F.lit(-1))
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "(none)").otherwise(c)
    return rows.select(
        none(F.col("session")).alias("session"), last("mapping").alias("mapping"), none(F.col("mapplet")).alias("mapplet"), F.coalesce("source_table", F.lit("")).alias("source_table"), F.coalesce("source_field", F.lit("")).alias("source_field"),
        F.col("target").alias("target_table"), last("field").alias("target_field"), F.coalesce(nearest["instance"], F.lit("(direct)")).alias("transformation"), F.coalesce(nearest["ttype"], F.lit("Target")).alias("transformation_type"),
        F.array_join(ends, " -> ").alias("full_path"), F.when(F.size(told) > 0, F.array_join(told, "\n")).otherwise("(pass-through / no transformation between source and target)").alias("individual"),
        dependency(F.col("crossing")).alias("dependency"), link.alias("links"), (F.col("hop") + F.col("added")).cast("int").alias("hop_count"), "run_path", "leaf_place",
    )


def hop_lineage(repo: Repository, scratch: Scratch, mapping: str | None = None, instance: str | None = None, max_hops: int = MAX_HOPS, outward: bool = False) -> DataFrame:
    """GR9, CQ5: one row a target field and visited port, in the order of a depth-first walk (column ord).

    A second arrival at a port, an arrival beyond `max_hops` and a field without a connector are rows too. A source that
    another session's mapping writes is followed by a row of that target and by the target's own rows, their hops added.
    With `outward` walks go on from a mapplet's input to what feeds the mapplet's instance; without, they end there.
    """
    repo = cached(repo, scratch)
    run = _run(repo, scratch, "hops", mapping, instance)
    w = walk(run.roots, run.flow, scratch, "hops", max_hops, outward)
    blank, none = F.lit(""), F.lit(None).cast("string")
    label, end = F.concat("instance", F.lit("."), "field"), F.concat("root.instance", F.lit("."), "root.field")
    passed = F.concat(F.transform(F.reverse("hops"), lambda h: h["label"]), F.array(end))
    joined = lambda parts: F.array_join(parts, " -> ")

    # What leads into a port, told once for all roots.
    e = run.flow.edges
    to = F.concat("to_instance", F.lit("."), "to_field")
    text = F.when(F.col("only").isNotNull() & (F.col("ord") > REFERENCES), F.concat(to, F.lit(" (referenced in expression) -> "), label)).otherwise(F.concat(to, F.lit(" -> "), label))
    wired = e.groupBy(*SCOPE, "instance", "field").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text"), "only"))).alias("wires"))
    wires = F.array_join(F.transform(F.filter("wires", lambda x: x["only"].isNull() | (x["only"] == F.col("itype"))), lambda x: x["text"]), "; ")
    states = w.states.where("itype <> 'MISSING'").join(wired, [*SCOPE, "instance", "field"], "left").withColumn("told", F.coalesce(F.nullif(wires, blank), F.lit(NO_UPSTREAM)))

    row = lambda df, transformation, ttype, full, logic, links, table=none, field=none, mapplet=F.col("mapplet"): df.select("root", "path", "hop", mapplet.alias("mapplet"), table.alias("source_table"), field.alias("source_field"), transformation.alias("transformation"), ttype.alias("transformation_type"), full.alias("full_path"), logic.alias("individual"), links.alias("links"))
    through = joined(F.concat(F.array(label), passed))
    nearest = F.coalesce(F.try_element_at("hops", F.lit(-1))["label"], end)
    named = lambda text: F.lit(text)
    rows = row(states.where("itype = 'SOURCE'"), F.col("table"), named("Source Table"), through, named("Original source field (Source Qualifier boundary reached)."), F.concat(label, F.lit(" -> "), nearest), F.col("table"), F.col("field"))
    entered = F.when(F.col("entry_instance").isNull(), "Mapplet boundary could not be resolved to an internal producing port; trace stops here.").otherwise(F.concat(F.lit("Enters Mapplet '"), "table", F.lit("' via its output port '"), "field", F.lit("'.")))
    rows = rows.unionByName(row(states.where("itype = 'MAPPLET'"), F.col("table"), named("Mapplet"), through, entered, label, mapplet=F.col("table")))
    rows = rows.unionByName(row(states.where("itype = 'TRANSFORMATION'"), F.col("instance"), F.col("ttype"), through, F.col("logic"), F.col("told")))
    alone = states.where("itype = 'TARGET' and size(path) = 0 and wires is null")
    rows = rows.unionByName(row(alone, F.col("instance"), named("Target"), label, named("No inbound connector found for this target field."), named("(unconnected target field)")))
    for df, kind, logic in ((w.markers, "(cycle)", CYCLE), (w.cut, "(truncated)", TRUNCATED)):
        rows = rows.unionByName(row(df, F.col("instance"), named(kind), joined(passed), named(logic), blank))
    placed = scratch.write(rows.select("*", F.row_number().over(Window.partitionBy("root").orderBy("path")).alias("leaf_place")), "hops-numbered")

    seen, reads = _followed(placed, run, repo, scratch, "hops")
    seen = scratch.write(seen, "hops-seen")
    at = placed.withColumnsRenamed({"root": "up_root"})
    own = seen.join(at, "up_root").select("up_root", F.array_append("run_path", (F.col("leaf_place") * HOP_DIGITS).cast("long")).alias("ord"), (F.col("hop") + F.col("added")).alias("hop_count"), *[c for c in placed.columns if c not in ("root", "path", "hop", "leaf_place")])
    # The row between a source and the rows of the target that another mapping writes.
    read_at = reads.select(F.col("root").alias("up_root"), "leaf_place", "hop", F.col("read").alias("n_read")).join(placed.select(F.col("root").alias("up_root"), "leaf_place", "source_table", "full_path"), ["up_root", "leaf_place"])
    child = seen.select(F.col("read").alias("n_read"), F.col("run_path").alias("n_path"), F.col("up_root").alias("n_root"))
    met = seen.join(read_at, "up_root").join(child, "n_read").where(F.col("n_path") == F.array_append("run_path", (F.col("leaf_place") * HOP_DIGITS + F.col("hop")).cast("long")))
    s = run.session
    met = met.join(s, [F.col("n_root.folder") == s.s_folder, F.col("n_root.mapping") == s.s_mapping], "left")
    cross = met.select(
        F.col("n_root").alias("up_root"), F.array_append("n_path", F.lit(0).cast("long")).alias("ord"), (F.col("hop") + F.col("added")).alias("hop_count"), blank.alias("mapplet"), none.alias("source_table"), none.alias("source_field"), F.col("n_root.instance").alias("transformation"),
        named("Previous Session Target").alias("transformation_type"), "full_path", F.concat(F.lit("Cross-session dependency: '"), "source_table", F.lit("' is populated by mapping '"), "n_root.mapping", F.lit("'"), F.coalesce(F.concat(F.lit(" (session '"), "session", F.lit("')")), blank), F.lit(" in an earlier load.")).alias("individual"),
        F.concat("n_root.instance", F.lit("."), "n_root.field", F.lit(" (cross-session)")).alias("links"),
    )
    rows = own.unionByName(cross).join(run.ranked.select(F.col("root").alias("up_root"), "target"), "up_root")
    rows = rows.join(s, [rows.up_root.folder == s.s_folder, rows.up_root.mapping == s.s_mapping], "left")
    or_none = lambda c: F.when(F.coalesce(c, blank) == "", "(none)").otherwise(F.col(c) if isinstance(c, str) else c)
    return rows.select(
        F.col("up_root.mapping").alias("mapping"), or_none("mapplet").alias("mapplet"), or_none("session").alias("session"), F.coalesce("source_table", blank).alias("source_table"), F.coalesce("source_field", blank).alias("source_field"), F.col("target").alias("target_table"), F.col("up_root.field").alias("target_field"),
        "transformation", "transformation_type", "full_path", "individual", "links", F.col("hop_count").cast("int").alias("hop_count"), "ord",
    )


def attribute_graph(repo: Repository, scratch: Scratch, mapping: str, instance: str, field: str, max_hops: int = MAX_HOPS) -> tuple[DataFrame, DataFrame]:
    """GR11, CQ9: (nodes, edges) of one attribute across sessions. nodes: id, kind, mapping, instance, table, field, ttype, logic, passthrough, hop (the least); edges: from, to, style.

    Sources whose table another mapping writes lead on to that mapping's target (execution order, then declaration);
    a target reached so is TARGET_INTERMEDIATE. Roots met before are not walked again. Hops count on over sessions, from the
    least of those that lead there; ports beyond `max_hops` are not shown.
    """
    repo = cached(repo, scratch)
    f = flow(repo, scratch)
    order = scratch.write(session_order(repo, scratch), "graph-sessions")
    roots = scratch.write(target_roots(repo), "graph-roots")
    final = (F.col("root.mapping") == mapping) & (F.col("root.instance") == instance) & (F.col("root.field") == field)
    front = roots.where(final).withColumn("hop", F.lit(0))
    p = scratch.write(producers(repo, order), "graph-producers")
    nodes = edges = done = None
    k = 0
    while not front.isEmpty():
        k += 1
        w = walk(front, f, scratch, f"graph{k}", max_hops)
        kind = F.when(F.col("itype") == "TARGET", F.when(final & (F.size("path") == 0), "TARGET_FINAL").otherwise("TARGET_INTERMEDIATE")).otherwise(F.col("itype"))
        here = w.states.where("itype <> 'MISSING'").select(_identity().alias("id"), kind.alias("kind"), "root.mapping", "instance", F.when(F.col("itype").isin("SOURCE", "TARGET"), F.col("table")).otherwise(F.lit("")).alias("table"), "field", "ttype", "logic", (~F.col("is_crossing")).alias("passthrough"), "hop")
        wires = w.links.where("shown").select(F.col("child").alias("from"), F.col("parent").alias("to"), "style").distinct()
        src = w.states.where("itype = 'SOURCE'").groupBy(_identity().alias("to"), F.col("root.folder").alias("folder"), F.col("root.mapping").alias("reader"), "table", F.lower("field").alias("field_key")).agg((F.min("hop") + 1).alias("hop")).where(F.col("hop") <= max_hops)
        up = src.join(p, ["folder", "table", "field_key"]).where("reader <> up_mapping").select("to", "up_root", "hop", F.row_number().over(Window.partitionBy("to").orderBy("place")).alias("_k")).where("_k = 1")
        up = scratch.write(up, f"graph-up{k}")
        cross = up.select(node_id(F.lit("mapping"), F.col("up_root.mapping"), F.col("up_root.instance"), F.col("up_root.field")).alias("from"), "to", F.lit("flow").alias("style"))
        nodes, edges = (here, wires.unionByName(cross)) if nodes is None else (nodes.unionByName(here), edges.unionByName(wires).unionByName(cross))
        done = front.select("root") if done is None else done.unionByName(front.select("root"))
        front = scratch.write(roots.join(up.groupBy(F.col("up_root").alias("root")).agg(F.min("hop").alias("hop")), "root").join(done, "root", "left_anti"), f"graph-front{k}")
    if nodes is None:
        raise ValueError(f"no target field {mapping}.{instance}.{field}")
    least = Window.partitionBy("id").orderBy(F.col("kind").desc())
    nodes = nodes.select("*", F.row_number().over(least).alias("_k"), F.min("hop").over(Window.partitionBy("id")).alias("_hop")).where("_k = 1")
    return nodes.drop("_k", "hop").withColumnRenamed("_hop", "hop"), edges.distinct()


@dataclass
class Panels:
    nodes: DataFrame  # of attribute_graph, and level
    edges: DataFrame  # from, to, style: without those that close a cycle
    dropped: DataFrame  # from, to, style: those that do
    panels: DataFrame  # mapping, place, node_count, level, incoming, outgoing: the asked mapping last
    crossings: DataFrame  # from_group, to_group, n: edges from one mapping's panel to another's


def attribute_panels(repo: Repository, scratch: Scratch, mapping: str, instance: str, field: str, max_hops: int = MAX_HOPS) -> Panels:
    """CQ9, GR12 to GR14: the graph of one attribute without cycles, its levels, and a panel for each mapping.

    A table that several mappings write and read can lead back over sessions. As the graph is found from the asked field
    backwards, the edges dropped, and told, are those into ports still open on the way from it. Panels are in the order of
    the first session of their mapping, then those without a session by level.
    """
    nodes, edges = attribute_graph(repo, scratch, mapping, instance, field, max_hops)
    nodes, edges = scratch.write(nodes, "panel-nodes"), scratch.write(edges, "panel-edges")
    upwards = edges.select(F.col("to").alias("src"), F.col("from").alias("dst"), "style")
    named = lambda df: df.select(F.col("dst").alias("from"), F.col("src").alias("to"), "style")
    kept, dropped = map(named, graph.break_cycles(nodes.select(F.col("id").alias("node"), F.col("hop").alias("ord")), upwards, scratch.sub("panels")))
    plain = kept.select(F.col("from").alias("src"), F.col("to").alias("dst"))
    levels = graph.longest_levels(nodes.select(F.col("id").alias("node")), plain, scratch.sub("panels"))
    leveled = scratch.write(nodes.join(levels.withColumnRenamed("node", "id"), "id"), "panel-levels")
    grouped = leveled.select(F.col("id").alias("node"), F.col("mapping").alias("grp"), "level")
    rank = session_order(repo, scratch).select(F.col("mapping").alias("grp"), F.col("exec_order").alias("rank"))
    return Panels(leveled, kept, dropped, graph.panels(grouped, plain, mapping, rank).withColumnRenamed("grp", "mapping"), graph.cross_counts(grouped, plain))
