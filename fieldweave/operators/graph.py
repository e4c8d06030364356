"""Graphs as tables of nodes and edges: paths, reachability, levels, panels, subgraphs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators.closure import first_visits
from fieldweave.scratch import Scratch


def paths(roots: DataFrame, edges: DataFrame, max_hops: int, scratch: Scratch | None = None) -> DataFrame:
    """GR1 on plain edges: root, leaf, path (array of nodes from the root) of every path that ends at a node without edges.

    `roots`: root; `edges`: src, dst. A node met twice ends the path without a leaf. One equi-join a hop; without
    `scratch` the hops are one lazy plan, with it each hop is written and the loop ends when no path is open.
    """
    front = roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    found = None
    for k in range(max_hops + 1):
        met = front.join(edges, front.node == edges.src, "left")
        if scratch is not None:
            met = scratch.write(met, f"paths{k}")
        done = met.where("src is null").select("root", F.col("node").alias("leaf"), "path")
        found = done if found is None else found.unionByName(done)
        front = met.where(F.col("src").isNotNull() & ~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        if scratch is not None and front.isEmpty():
            break
    return found


def reachable(starts: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """GR11's node set, GR8's visited sets: node, by edges src to dst, starts included. Nodes met before are dropped."""
    seen = scratch.write(starts.select("node").distinct(), "reach0")
    front = seen
    for k in count(1):
        new = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = scratch.write(new, f"reach-front{k}")
        if front.isEmpty():
            return seen
        seen = scratch.write(seen.unionByName(front), f"reach{k}")


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR16: distinct edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns).distinct()


#: Edges that taking out one node may add, beyond those that it takes out.
FILL = 3


@dataclass
class Cut:
    """A round of `eliminate`: what was taken out, and the edges it had then."""

    nodes: DataFrame  # node
    into: DataFrame  # node, other, w: edges from other
    out: DataFrame  # node, other, w: edges to other


def eliminate(edges: DataFrame, scratch: Scratch, name: str, starts: bool = False) -> tuple[list[Cut], DataFrame, DataFrame | None]:
    """(rounds, core, gone): takes nodes out of a graph, a share of them each round, so that chains of n take about log n rounds.

    `edges`: src, dst, distinct, and w if an edge is longer or shorter than 1. Nodes taken out in one round have no edges between
    them; each leaves an edge from every node before it to every one behind it, with the length w of the longest way, so who
    reaches whom stays as it was. Nodes that would add many edges wait; those without an edge in or out never do. core: what is
    left when all nodes wait, empty if the graph has no cycle. gone: node: all that were taken out. With `starts` a way that
    begins at a node that was taken out is an edge whose src is null, and a cycle stays in the core as an edge from a node to itself.

    A round is three tables and as few shuffles as that allows: small graphs take as long as their jobs take to start.
    """
    open_ = scratch.write(edges.select("src", "dst", F.col("w") if "w" in edges.columns else F.lit(1).alias("w")), f"{name}-open0")
    rounds: list[Cut] = []
    for k in count(1):
        if open_.isEmpty():
            break
        real = F.col("src").isNotNull()
        ends = open_.where(real).select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(open_.select(F.col("dst").alias("node"), real.cast("int").alias("i"), F.lit(0).alias("o")))
        size = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        may = size.where(F.col("i") * F.col("o") <= F.col("i") + F.col("o") + FILL).select("node", F.struct((F.col("i") * F.col("o")).alias("cost"), F.xxhash64("node").alias("h"), "node").alias("turn"))
        met = open_.join(may.select(F.col("node").alias("src"), F.col("turn").alias("t_src")), "src").join(may.select(F.col("node").alias("dst"), F.col("turn").alias("t_dst")), "dst")
        later = met.select(F.when(F.col("t_src") > F.col("t_dst"), F.col("src")).otherwise(F.col("dst")).alias("node")).distinct()
        cut = scratch.write(may.select("node").join(later, "node", "left_anti"), f"{name}-cut{k}")
        if cut.isEmpty():
            break
        mark = lambda c: cut.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_cut"))  # noqa: B023, E731
        marked = scratch.write(open_.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left"), f"{name}-marked{k}")
        into, out = marked.where("dst_cut").select(F.col("dst").alias("node"), F.col("src").alias("other"), "w"), marked.where("src_cut").select(F.col("src").alias("node"), F.col("dst").alias("other"), "w")
        rounds.append(Cut(cut, into, out))
        ways = into.select("node", F.col("other").alias("src"), F.col("w").alias("w1")).join(out.select("node", F.col("other").alias("dst"), F.col("w").alias("w2")), "node").select("src", "dst", (F.col("w1") + F.col("w2")).alias("w"))
        ways = ways.unionByName(out.select(F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.col("other").alias("dst"), "w")) if starts else ways.where("src <> dst")
        rest = marked.where("src_cut is null and dst_cut is null").select("src", "dst", "w")
        open_ = scratch.write(rest.unionByName(ways).groupBy("src", "dst").agg(F.max("w").alias("w")), f"{name}-open{k}")
    return rounds, open_, scratch.held([f"{name}-cut{k + 1}" for k in range(len(rounds))], rounds[0].nodes) if rounds else None


#: Rounds of `longest_levels` after which it is asked whether as many nodes a round would end the walk soon, and how many more are soon.
ASK, SOON = 4, 16


def longest_levels(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """GR13: node, level: 0 without predecessors, else one more than the highest predecessor's. Edges src to dst, acyclic.

    `edges` may have w: a level's distance from that predecessor's, if not 1. Each round takes the nodes that no open node
    leads to. Where that would be many rounds, nodes are taken out by `eliminate` and put back in the opposite order, each
    behind those that led to it: about log n rounds. A cycle: ValueError.
    """
    open_ = scratch.write(nodes.select("node").distinct(), "open0")
    far = "w" in edges.columns
    links = scratch.write(subgraph(open_, edges.select("src", "dst", *(["w"] if far else []))), "links0")
    found, first = [], 0
    while not far:
        heads = scratch.write(open_.join(links.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(first).alias("level")), f"levels{first}")
        n, left = heads.count(), open_.count()
        if not n and left:
            raise ValueError("the graph has a cycle")
        found.append(heads)
        first += 1
        if n == left:
            return reduce(DataFrame.unionByName, found)
        open_ = scratch.write(open_.join(heads, "node", "left_anti"), f"open{first}")
        links = scratch.write(links.join(heads.select(F.col("node").alias("src")), "src", "left_anti"), f"links{first}")
        if first >= ASK and left - n > SOON * n:
            break
    rounds, core, gone = eliminate(links, scratch, "levels-cut", starts=True)
    if not core.isEmpty():
        raise ValueError("the graph has a cycle")
    low = F.lit(first)
    found.append((open_ if gone is None else open_.join(gone, "node", "left_anti")).select("node", low.alias("level")))
    put: list[str] = []
    for k, r in reversed(list(enumerate(rounds))):
        led = r.into.select("node", "other", "w")
        led = led.join(scratch.held(put, like).select(F.col("node").alias("other"), "level"), "other", "left") if put else led.withColumn("level", low)
        led = led.select("node", (F.coalesce("level", low) + F.col("w")).alias("level"))
        like = scratch.write(r.nodes.select("node", low.alias("level")).unionByName(led).groupBy("node").agg(F.max("level").alias("level")), f"levels-put{k}")
        put.append(f"levels-put{k}")
    return reduce(DataFrame.unionByName, [*found, scratch.held(put, like)] if put else found)


def strong_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch, name: str = "strong") -> DataFrame:
    """node, component: the least node of those that each other reach by edges src to dst; a node on no cycle is its own.

    Nodes are taken out by `eliminate`, which keeps who reaches whom, and the components of the core are found. Put back in the
    opposite order, a node is of the component that it both leads to and is led to by, if there is one.
    """
    own = scratch.write(nodes.select("node").distinct(), f"{name}-nodes")
    rounds, core, _ = eliminate(subgraph(own, edges.select("src", "dst")).where("src <> dst"), scratch, f"{name}-cut")
    found = _core_components(core, scratch, name)
    put = []
    if found is not None:
        found = scratch.write(found, f"{name}-put")
        put.append(f"{name}-put")
    for k, r in reversed(list(enumerate(rounds))):
        sides = r.into.select("node", "other", F.lit(1).alias("way")).unionByName(r.out.select("node", "other", F.lit(2).alias("way")))
        sides = sides.join(found.select(F.col("node").alias("other"), "component"), "other", "left").select("node", "way", F.coalesce("component", "other").alias("component")) if put else sides.select("node", "way", F.col("other").alias("component"))
        both = sides.groupBy("node", "component").agg(F.min("way").alias("low"), F.max("way").alias("high")).where("low < high")
        at = scratch.write(both.select("node", "component"), f"{name}-put{k}")
        if put or not at.isEmpty():
            put.append(f"{name}-put{k}")
            found = scratch.held(put, at)
    if found is None:
        return own.select("node", F.col("node").alias("component"))
    named = own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("named"))
    return named.join(named.groupBy("named").agg(F.min("node").alias("component")), "named").select("node", "component")


def _core_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """node, component of nodes on cycles of `edges`, for graphs whose nodes have many edges; None if there is none.

    Nodes without an open edge in or out are done, round by round. Of the rest each takes the least node that reaches it;
    a node that is its own least, and what reaches it among those that took it, are a component. All colours go on at once.
    """
    open_ = edges.select("src", "dst")
    found = None
    for k in count(1):
        for t in count():
            into, out = open_.select(F.col("dst").alias("node")).distinct(), open_.select(F.col("src").alias("node")).distinct()
            both = into.join(out, "node", "left_semi")
            left = scratch.write(subgraph(both, open_), f"{name}-{k}-trim{t}")
            done = left.count() == open_.count()
            open_ = left
            if done:
                break
        if open_.isEmpty():
            break
        # The least node that reaches each: labels fall along edges until none does.
        color = scratch.write(open_.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")), f"{name}-{k}-color0")
        for t in count(1):
            fed = open_.join(color.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("low"))
            lower = scratch.write(color.join(fed, "node").select("node", F.least("color", "low").alias("color"), (F.col("low") < F.col("color")).alias("fell")), f"{name}-{k}-color{t}")
            color = lower.drop("fell")
            if lower.where("fell").isEmpty():
                break
        # Backwards from each colour's own node, inside the colour.
        ends = open_.join(color.select(F.col("node").alias("src"), F.col("color").alias("c_src")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c_dst")), "dst")
        inside = scratch.write(ends.where("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), f"{name}-{k}-back")
        met = reachable(color.where("node = color"), inside, scratch.sub(f"{name}-{k}"))
        part = scratch.write(color.join(met, "node", "left_semi").select("node", F.col("color").alias("component")), f"{name}-{k}-part")
        found = part if found is None else found.unionByName(part)
        open_ = scratch.write(open_.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"), f"{name}-{k}-open")
    return found


def break_cycles(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """GR12: (kept, dropped) edges. Dropped are those that lead back to an open node of a depth-first walk; what is kept has no cycle.

    `nodes`: node, and ord if their order is another than by name; `edges`: src, dst, any other columns, and ord likewise.
    An edge between two strong components is on no cycle, so only components of several nodes are walked, all at once,
    each from its first node; a walk's first visits are its least paths, and an edge leads back if the path of its dst is
    the first part of that of its src. Edges without one of their ends among the nodes are left out.
    """
    order = lambda df, by: F.col("ord") if "ord" in df.columns else F.col(by)
    held = scratch.write(subgraph(nodes, edges), "held")
    parts = scratch.write(strong_components(nodes, held, scratch), "components")
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    placed = scratch.write(held.join(side("src"), "src").join(side("dst"), "dst"), "placed")
    inner = placed.where("c_src = c_dst")
    starts = nodes.join(parts, "node").join(inner.select(F.col("c_src").alias("component")).distinct(), "component", "left_semi")
    starts = starts.groupBy(F.col("component").alias("root")).agg(F.min_by("node", F.struct(order(nodes, "node").alias("o"), "node")).alias("node"))
    turn = F.row_number().over(Window.partitionBy("src").orderBy(order(edges, "dst"), "dst"))
    steps = inner.select(F.col("src").alias("node"), F.col("dst").alias("next_node"), turn.alias("ord"))
    visits = first_visits(starts, steps, ["node"], scratch, "visits")
    at = lambda c: visits.select(F.col("node").alias(c), F.col("path").alias(f"p_{c}"))
    told = placed.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    back = (F.col("c_src") == F.col("c_dst")) & (F.slice("p_src", F.lit(1), F.size("p_dst")) == F.col("p_dst"))
    told = scratch.write(told.select(*edges.columns, F.coalesce(back, F.lit(False)).alias("back")), "told")
    return told.where("not back").drop("back"), told.where("back").drop("back")


def levels_of(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GR12 and GR13 on any graph: (levels, kept, dropped), levels over the edges that are kept."""
    kept, dropped = break_cycles(nodes, edges, scratch)
    return longest_levels(nodes, kept, scratch), kept, dropped


def cross_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AG10: from_group, to_group, n: edges between nodes of different groups. `nodes`: node, grp."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("grp").alias("from_group")), nodes.select(F.col("node").alias("dst"), F.col("grp").alias("to_group"))
    return edges.join(a, "src").join(b, "dst").where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("n"))


def panels(nodes: DataFrame, edges: DataFrame, final_group: str, rank: DataFrame) -> DataFrame:
    """GR14, AG11, W4, SO3: grp, place, node_count, level, incoming, outgoing; by first rank and name, the final group last.

    `nodes`: node, grp, level; `rank`: grp, rank (groups without one follow by level).
    """
    base = nodes.groupBy("grp").agg(F.count("*").alias("node_count"), F.min("level").alias("level"))
    cross = cross_counts(nodes, edges)
    into = cross.groupBy(F.col("to_group").alias("grp")).agg(F.sum("n").alias("incoming"))
    out = cross.groupBy(F.col("from_group").alias("grp")).agg(F.sum("n").alias("outgoing"))
    first = rank.groupBy("grp").agg(F.min("rank").alias("rank"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = base.join(into, "grp", "left").join(out, "grp", "left").join(first, "grp", "left")
    place = F.row_number().over(Window.orderBy((F.col("grp") == final_group).asc(), F.col("rank").asc_nulls_last(), F.when(F.col("rank").isNull(), F.col("level")), "grp"))
    return rows.select("grp", place.alias("place"), "node_count", "level", zero("incoming"), zero("outgoing"))


def overview(tasks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR15, CQ10: (nodes, edges) of each workflow: its tasks, and its links between tasks it has; the last of parallel links labels.

    nodes: folder, workflow, id, label, kind; edges: folder, workflow, from, to, label.
    """
    keys = ["folder", "workflow"]
    label = F.when(F.col("tasktype") == "Session", F.col("task")).otherwise(F.concat("task", F.lit("\n["), F.coalesce("tasktype", F.lit("")), F.lit("]")))
    nodes = tasks.groupBy(*keys, F.col("task").alias("id")).agg(F.max_by(F.struct("task", "tasktype"), "ord").alias("t")).select(*keys, "id", "t.*").select(*keys, "id", label.alias("label"), F.col("tasktype").alias("kind"))
    there = lambda side: nodes.select(*keys, F.col("id").alias(side))
    known = links.join(there("from_task"), [*keys, "from_task"], "left_semi").join(there("to_task"), [*keys, "to_task"], "left_semi")
    edges = known.groupBy(*keys, F.col("from_task").alias("from"), F.col("to_task").alias("to")).agg(F.max_by(F.coalesce("condition", F.lit("")), "ord").alias("label"))
    return nodes, edges


def canvas(instances: DataFrame, connectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR15, CQ10: (nodes, edges) of every mapping and mapplet: its instances, and one edge for all wires of a pair.

    An instance that wires name and the scope lacks is a node without a kind. nodes: folder, scope_kind, scope, id,
    label, kind; edges: folder, scope_kind, scope, from, to, label (blank).
    """
    keys = ["folder", "scope_kind", "scope"]
    own = instances.groupBy(*keys, F.col("instance").alias("id")).agg(F.max_by(F.struct(F.coalesce("transformation_name", "instance").alias("label"), F.col("type").alias("kind")), "ord").alias("i")).select(*keys, "id", "i.label", "i.kind")
    edges = connectors.select(*keys, F.col("from_instance").alias("from"), F.col("to_instance").alias("to"), F.lit("").alias("label")).distinct()
    ends = edges.select(*keys, F.col("from").alias("id")).union(edges.select(*keys, "to")).distinct().join(own.select(*keys, "id"), [*keys, "id"], "left_anti")
    return own.unionByName(ends.select(*keys, "id", F.col("id").alias("label"), F.lit(None).cast("string").alias("kind"))), edges


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK7: one row: {nodes: [id, label, kind], edges: [from, to, label]}, sorted. For graphs small enough to show."""
    n = nodes.agg(F.array_sort(F.collect_set(F.struct("id", "label", "kind"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_set(F.struct("from", "to", "label"))).alias("edges"))
    return n.join(F.broadcast(e), F.lit(True)).select(F.to_json(F.struct("nodes", "edges")).alias("graph"))


def capped_groups(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """LT2 and AG12 on any table: the first `most` rows of a group, kept true, and one row with the count of the rest."""
    w = Window.partitionBy(group)
    ranked = rows.select("*", F.row_number().over(w.orderBy(*order)).alias("place"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("place") <= most + 1).select(*rows.columns, "place", F.when(F.col("place") > most, F.col("n") - most).otherwise(0).alias("omitted"))
