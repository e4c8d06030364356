"""Strong components, broken cycles and levels over random graphs, against depth-first walks; panels over sessions that read each other."""

import numpy as np
import pytest

from fieldweave.operators import graph
from fieldweave.plans import dependency
from fieldweave.scratch import Scratch
from fieldweave.sources.compact import document
from fieldweave.sources.repository import cached, from_json


def reach(nodes, edges):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in out[n]:
                    out[n].add(b)
    return out


def back_edges(members, edges):
    """Edges to an open node of a walk over one component, from its first node, successors by name."""
    state, back = {}, set()

    def go(u):
        state[u] = "open"
        for a, b in sorted(edges):
            if a == u and b in members:
                if state.get(b) == "open":
                    back.add((a, b))
                elif b not in state:
                    go(b)
        state[u] = "done"

    go(min(members))
    return back


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = [f"n{k:02}" for k in range(12)]
    edges = {(nodes[a], nodes[b]) for a, b in rng.integers(0, 12, ((6, 14, 20, 40)[seed], 2))}
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame([(*x, "gone") for x in edges] + [("n00", "elsewhere", "x")], "src string, dst string, style string").coalesce(1)
    seen = reach(nodes, edges)
    component = {x: min(y for y in nodes if y in seen[x] and x in seen[y]) for x in nodes}
    assert {tuple(r) for r in graph.strong_components(n, e, Scratch(spark)).collect()} == set(component.items())
    want = set()
    for c in set(component.values()):
        members = {x for x in nodes if component[x] == c}
        want |= back_edges(members, {x for x in edges if set(x) <= members})
    levels, kept, dropped = graph.levels_of(n, e, Scratch(spark))
    assert {(r["src"], r["dst"]) for r in dropped.collect()} == want and {(r["src"], r["dst"]) for r in kept.collect()} == edges - want
    level = {}
    for _ in nodes:
        level = {x: max([1 + level.get(a, 0) for a, b in edges - want if b == x], default=0) for x in nodes}
    assert {tuple(r) for r in levels.collect()} == set(level.items())


def test_no_nodes(spark):
    none = spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string")
    levels, kept, dropped = graph.levels_of(*none, Scratch(spark))
    assert levels.isEmpty() and kept.isEmpty() and dropped.isEmpty()


def test_sessions_that_read_each_other(spark):
    """m1 and m2 write what the other reads, by one field: one edge back is dropped and told, and panels still have levels."""
    one = "MAPPING{{NAME={0}}}[TRANSFORMATION{{NAME=E;TYPE=Expression}}[TRANSFORMFIELD{{NAME=P;PORTTYPE=INPUT/OUTPUT}}] INSTANCE{{NAME=E;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=E;TRANSFORMATION_TYPE=Expression}} INSTANCE{{NAME=S;TYPE=SOURCE;TRANSFORMATION_NAME={1}}} INSTANCE{{NAME=T;TYPE=TARGET;TRANSFORMATION_NAME={2}}} CONNECTOR S.A(Source Definition) -> E.P CONNECTOR E.P(Expression) -> T.A]"
    tables = " ".join(f"SOURCE{{NAME={t}}}[SOURCEFIELD{{NAME=A}}] TARGET{{NAME={t}}}[TARGETFIELD{{NAME=A}}]" for t in ("X", "Y", "Z"))
    tasks = " ".join(f"TASKINSTANCE{{NAME=s{k};TASKTYPE=Session}} SESSION{{NAME=s{k};MAPPINGNAME=m{k}}}" for k in (1, 2, 3))
    text = f"FOLDER{{NAME=F}}[{tables} {one.format('m1', 'Y', 'X')} {one.format('m2', 'X', 'Y')} {one.format('m3', 'X', 'Z')} WORKFLOW{{NAME=W}}[{tasks} WORKFLOWLINK{{FROMTASK=s1;TOTASK=s2}} WORKFLOWLINK{{FROMTASK=s2;TOTASK=s3}}]]"
    repo = cached(from_json(spark.createDataFrame([(document(text),)], "d string")), Scratch(spark))
    p = dependency.attribute_panels(repo, Scratch(spark), "m3", "T", "A")
    assert p.nodes.count() == 9 and p.edges.count() == 8 and p.dropped.count() == 1
    rows = {r["mapping"]: (r["place"], r["node_count"], r["incoming"], r["outgoing"]) for r in p.panels.collect()}
    assert rows["m3"] == (3, 3, 1, 0) and {m: x[0] for m, x in rows.items()} == {"m1": 1, "m2": 2, "m3": 3}
    assert max(r["level"] for r in p.nodes.collect()) == 8
    assert sum(r["n"] for r in p.crossings.collect()) == 2
