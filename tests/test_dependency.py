"""Hop and flat dependency reports over random mappings and long chains, against a walker that follows one path at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.plans import dependency
from fieldweave.scratch import Scratch
from fieldweave.sources.compact import document
from fieldweave.sources.repository import cached, from_json

EXPRESSIONS = {"ia + ibb": ["ibb", "ia"], "vccc": ["vccc"], "ibb": ["ibb"], "SYSDATE": [], "IIF(vccc > 1, ia, ibb)": ["vccc", "ibb", "ia"], "": []}
NOTES = (dependency.CYCLE, dependency.TRUNCATED)


def mapping(rng, name, reads, writes):
    """Wires to (instance, field), in order, and the expression of each port of five Expression instances."""
    inst = [f"E{k}" for k in range(5)]
    outs = [(e, o) for e in inst for o in ("oddd", "oeeee")] + [("S", "A"), ("S", "B")] * 2
    wires = {}
    for to in [(e, i) for e in inst for i in ("ia", "ibb")] + [("T", x) for x in "ABC"]:
        picks = [outs[k] for k in rng.choice(len(outs), int(rng.random() < 0.85) + int(rng.random() < 0.4), replace=False)]
        wires[to] = list(dict.fromkeys(picks))
    exprs = {(e, p): str(rng.choice([x for x in EXPRESSIONS if p not in EXPRESSIONS[x]])) for e in inst for p in ("vccc", "oddd", "oeeee")}
    return {"name": name, "reads": reads, "writes": writes, "wires": wires, "exprs": exprs}


def written(maps, order):
    parts = []
    for m in maps:
        kinds = lambda i: "Source Definition" if i == "S" else "Expression"
        for e in sorted({e for e, _ in m["exprs"]}):
            ports = "TRANSFORMFIELD{NAME=ia;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=ibb;PORTTYPE=INPUT} " + " ".join(f"TRANSFORMFIELD{{NAME={p};PORTTYPE={'LOCAL VARIABLE' if p == 'vccc' else 'OUTPUT'};EXPRESSION={m['exprs'][e, p]}}}" for p in ("vccc", "oddd", "oeeee"))
            parts.append((m["name"], f"TRANSFORMATION{{NAME={e};TYPE=Expression}}[{ports}] INSTANCE{{NAME={e};TYPE=TRANSFORMATION;TRANSFORMATION_NAME={e};TRANSFORMATION_TYPE=Expression}}"))
        parts.append((m["name"], f"INSTANCE{{NAME=S;TYPE=SOURCE;TRANSFORMATION_NAME={m['reads']}}} INSTANCE{{NAME=T;TYPE=TARGET;TRANSFORMATION_NAME={m['writes']}}}"))
        parts.append((m["name"], " ".join(f"CONNECTOR {a}.{b}({kinds(a)}) -> {i}.{f}" for (i, f), froms in m["wires"].items() for a, b in froms)))
    inside = {m["name"]: " ".join(t for n, t in parts if n == m["name"]) for m in maps}
    tables = " ".join(f"SOURCE{{NAME={t}}}[SOURCEFIELD{{NAME=A}} SOURCEFIELD{{NAME=B}}] TARGET{{NAME={t}}}[TARGETFIELD{{NAME=A}} TARGETFIELD{{NAME=B}} TARGETFIELD{{NAME=C}}]" for t in sorted({m["reads"] for m in maps} | {m["writes"] for m in maps}))
    tasks = " ".join(f"TASKINSTANCE{{NAME=s_{n};TASKTYPE=Session}} SESSION{{NAME=s_{n};MAPPINGNAME={n}}}" for n in order)
    links = " ".join(f"WORKFLOWLINK{{FROMTASK=s_{a};TOTASK=s_{b}}}" for a, b in zip(order, order[1:], strict=False))
    return document(f"FOLDER{{NAME=F}}[{tables} {' '.join(f'MAPPING{{NAME={n}}}[{t}]' for n, t in inside.items())} WORKFLOW{{NAME=W}}[{tasks} {links}]]")


def hop_rows(maps, order, limit):
    """Rows of all target fields, by sessions in order; each (mapping, table, field) is followed once."""
    by_name, followed, out = {m["name"]: m for m in maps}, set(), []

    def field(m, target_field, offset, rows):
        visited = set()
        row = lambda *x: rows.append((m["name"], f"s_{m['name']}", m["writes"], target_field, *x[:-1], x[-1] + offset))

        def walk(i, f, hop, labels):
            path, label = " -> ".join(reversed(labels)), f"{i}.{f}"
            if hop > limit:
                return row(i, "(truncated)", path, dependency.TRUNCATED, "", hop)
            if (i, f) in visited:
                return row(i, "(cycle)", path, dependency.CYCLE, "", hop)
            visited.add((i, f))
            path = " -> ".join(reversed([*labels, label]))
            if i == "S":
                row(m["reads"], "Source Table", path, "Original source field (Source Qualifier boundary reached).", f"{label} -> {labels[-1]}", hop)
                return cross(m, f, hop + offset, path, rows)
            expr = m["exprs"].get((i, f), "")
            froms, refs = m["wires"].get((i, f), []), EXPRESSIONS[expr]
            links = [f"{a}.{b} -> {label}" for a, b in froms] + [f"{i}.{r} (referenced in expression) -> {label}" for r in refs]
            logic = expr or (dependency.INPUT_NOTE if f.startswith("i") else dependency.PASS_NOTE)
            row(i, "Expression", path, logic, "; ".join(links) or dependency.NO_UPSTREAM, hop)
            for a, b in froms:
                walk(a, b, hop + 1, [*labels, label])
            for r in refs:
                walk(i, r, hop + 1, [*labels, label])

        label = f"T.{target_field}"
        if not m["wires"]["T", target_field]:
            row("T", "Target", label, "No inbound connector found for this target field.", "(unconnected target field)", 0)
        for a, b in m["wires"]["T", target_field]:
            walk(a, b, 1, [label])

    def cross(m, f, hop, path, rows):
        if (m["name"], m["reads"], f) in followed:
            return
        followed.add((m["name"], m["reads"], f))
        for up in maps:
            if up["name"] != m["name"] and up["writes"] == m["reads"]:
                text = f"Cross-session dependency: '{m['reads']}' is populated by mapping '{up['name']}' (session 's_{up['name']}') in an earlier load."
                rows.append((up["name"], f"s_{up['name']}", up["writes"], f, "T", "Previous Session Target", path, text, f"T.{f} (cross-session)", hop))
                return field(up, f, hop, rows)

    for name in order:
        for x in "ABC":
            field(by_name[name], x, 0, out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_mappings(spark, seed):
    rng = np.random.default_rng(seed)
    maps = [mapping(rng, "m0", "RAW", "MID"), mapping(rng, "m1", "MID", "OUT"), mapping(rng, "m2", "OUT", "MID")]
    order = ["m0", "m1", "m2"]
    repo = cached(from_json(spark.createDataFrame([(written(maps, order),)], "d string")), Scratch(spark))
    limit = (60, 3, 5, 2)[seed]
    got = sorted(dependency.hop_lineage(repo, Scratch(spark), max_hops=limit).collect(), key=lambda r: r["ord"])
    want = hop_rows(maps, order, limit)
    assert [(r["mapping"], r["session"], r["target_table"], r["target_field"], *r[7:13]) for r in got] == want
    assert any(r[5] == "Previous Session Target" for r in want) and (limit == 60 or any(r[5] == "(truncated)" for r in want))
    # The flat report has the ends of the same walks.
    flat = dependency.flat_lineage(repo, Scratch(spark), max_hops=limit).collect()
    ends = sorted((r[3], r[9]) for r in want if r[5] in ("Source Table", "(cycle)", "(truncated)", "Target") or r[8] == dependency.NO_UPSTREAM)
    assert sorted((r["target_field"], r["hop_count"]) for r in flat) == ends


def chain(n):
    inst = " ".join(f"TRANSFORMATION{{NAME=E{k};TYPE=Expression}}[TRANSFORMFIELD{{NAME=P;PORTTYPE=INPUT/OUTPUT}}] INSTANCE{{NAME=E{k};TYPE=TRANSFORMATION;TRANSFORMATION_NAME=E{k};TRANSFORMATION_TYPE=Expression}}" for k in range(n))
    wires = " ".join(f"CONNECTOR E{k}.P(Expression) -> E{k + 1}.P" for k in range(n - 1))
    return document(f"FOLDER{{NAME=F}}[SOURCE{{NAME=S}}[SOURCEFIELD{{NAME=A}}] TARGET{{NAME=T}}[TARGETFIELD{{NAME=A}}] MAPPING{{NAME=m}}[{inst} INSTANCE{{NAME=S;TYPE=SOURCE;TRANSFORMATION_NAME=S}} INSTANCE{{NAME=T;TYPE=TARGET;TRANSFORMATION_NAME=T}} CONNECTOR S.A(Source Definition) -> E0.P {wires} CONNECTOR E{n - 1}.P(Expression) -> T.A]]")


def test_chains_longer_than_the_limit(spark):
    repo = cached(from_json(spark.createDataFrame([(chain(70),)], "d string")), Scratch(spark))
    flat = dependency.flat_lineage(repo, Scratch(spark)).collect()
    assert [(r["source_table"], r["target_field"], r["hop_count"]) for r in flat] == [("", "A", 61)] and flat[0]["individual"].endswith(dependency.TRUNCATED)
    short = cached(from_json(spark.createDataFrame([(chain(9),)], "d string")), Scratch(spark))
    hops = sorted(dependency.hop_lineage(short, Scratch(spark), max_hops=6).collect(), key=lambda r: r["ord"])
    assert [(r["transformation"], r["transformation_type"], r["hop_count"]) for r in hops] == [*[(f"E{8 - k}", "Expression", k + 1) for k in range(6)], ("E2", "(truncated)", 7)]
    assert [r["hop_count"] for r in dependency.flat_lineage(short, Scratch(spark), max_hops=10).collect()] == [10]
    nodes, edges = dependency.attribute_graph(short, Scratch(spark), "m", "T", "A", max_hops=6)
    ids = {r["id"] for r in nodes.collect()}
    assert len(ids) == 7 and {x for r in edges.collect() for x in (r["from"], r["to"])} == ids
    assert edges.select(F.countDistinct("from", "to")).first()[0] == 6
