"""A short notation for repository documents: TAG{key=value; ...}[children], connectors as `CONNECTOR a.x(Type) -> b.y(Type)`."""

from __future__ import annotations

import json
import re

_HEAD = re.compile(r"\s*([A-Z]+)\s*")
_WIRE = re.compile(r"\s*CONNECTOR\s+(\w+)\.(\w+)(?:\(([^)]*)\))?\s*->\s*(\w+)\.(\w+)(?:\(([^)]*)\))?")


def parse(text: str, at: int = 0) -> tuple[list[dict], int]:
    """Nodes from `at` up to a closing bracket or the end, and where that is."""
    nodes = []
    while True:
        if wire := _WIRE.match(text, at):
            keys = ("FROMINSTANCE", "FROMFIELD", "FROMINSTANCETYPE", "TOINSTANCE", "TOFIELD", "TOINSTANCETYPE")
            nodes.append({"tag": "CONNECTOR", "attributes": {k: v for k, v in zip(keys, wire.groups(), strict=True) if v}, "children": []})
            at = wire.end()
            continue
        head = _HEAD.match(text, at)
        if not head:
            break
        node: dict = {"tag": head[1], "attributes": {}, "children": []}
        at = head.end()
        if text[at : at + 1] == "{":
            end = text.index("}", at)
            node["attributes"] = {k.strip(): v for k, _, v in (x.partition("=") for x in text[at + 1 : end].split(";") if x.strip())}
            at = end + 1
        if text[at : at + 1] == "[":
            node["children"], at = parse(text, at + 1)
            at = text.index("]", at) + 1
        nodes.append(node)
    return nodes, at


def document(folders: str) -> str:
    """The JSON document of one repository with the given folders."""
    nodes, _ = parse(folders)
    return json.dumps({"root": {"children": [{"tag": "REPOSITORY", "attributes": {"NAME": "R"}, "children": nodes}]}})
