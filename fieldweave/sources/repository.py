"""Repository documents as tables.

A document, JSON or XML, is a tree of nodes with a tag, attributes and children. It is parsed as VARIANT and exploded level by level;
the depth is known, so no recursion is needed, and documents are read in parallel. `ord` columns hold document order.
Of equal names in one parent the last one counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields, replace
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key of a scope: a folder's reusable part, a mapping or a mapplet.
SCOPE = ["folder", "scope_kind", "scope"]


@dataclass
class Repository:
    source_field: DataFrame  # folder, source, field, ord
    target_field: DataFrame  # folder, target, field, ord
    transformation: DataFrame  # SCOPE, name, type, attrs
    port: DataFrame  # SCOPE, transformation, port, ord, porttype, expression, ref_field, ref_instancetype, grp, grp_pos, datatype, precision, scale, expression_type, attrs
    port_group: DataFrame  # SCOPE, transformation, grp, grp_type, ord, attrs
    scope: DataFrame  # SCOPE, ord: mappings and mapplets
    instance: DataFrame  # SCOPE, instance, type, transformation_name, transformation_type, ord
    connector: DataFrame  # SCOPE, ord, from_instance, from_field, from_type, to_instance, to_field, to_type
    task: DataFrame  # folder, workflow, wf_ord, task, tasktype, ord
    session: DataFrame  # folder, workflow, wf_ord, session, mapping, ord
    wlink: DataFrame  # folder, workflow, from_task, to_task, condition, ord

    def map(self, change) -> Repository:
        """The same tables, each changed."""
        return replace(self, **{f.name: change(f.name, getattr(self, f.name)) for f in fields(self)})


def _kids(df: DataFrame, ord_name: str, keep: list) -> DataFrame:
    """Children of `v`: kept columns, position, tag, attributes, node."""
    rows = df.select(*keep, F.posexplode(F.expr("variant_get(v, '$.children', 'array<variant>')")).alias(ord_name, "v"))
    names = [c for c in rows.columns if c not in (ord_name, "v")]
    return rows.select(*names, ord_name, F.expr("variant_get(v, '$.tag', 'string')").alias("tag"), F.coalesce(F.expr("variant_get(v, '$.attributes', 'map<string,string>')"), F.expr("cast(map() as map<string,string>)")).alias("a"), "v")


def attr(name: str) -> Column:
    """An attribute of the current node, null if blank or missing."""
    return F.nullif(F.col("a").getItem(name), F.lit(""))


def _last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by `order`."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.select("*", F.row_number().over(w).alias("_k")).where("_k = 1").drop("_k")


def _bag(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Maps of NAME to VALUE of attribute nodes in document order; the last of equal names counts."""
    named = _last(rows.where(attr("NAME").isNotNull()).select(*keys, order, attr("NAME").alias("k"), F.coalesce(F.col("a").getItem("VALUE"), F.lit("")).alias("val")), [*keys, "k"], order)
    return named.groupBy(*keys).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "k", "val"))), lambda x: F.struct(x["k"].alias("k"), x["val"].alias("val")))).alias("bag"))


def from_json(documents: DataFrame, first_folder_only: bool = True) -> Repository:
    """Tables of a DataFrame with one column of JSON documents. Of a document's folders the first alone, unless told otherwise.

    Names are resolved within a document. Documents with folders of one name give the rows of both under that name.
    """
    text = F.col(documents.columns[0])
    top = documents.select(F.xxhash64(text).alias("doc"), F.parse_json(text).alias("d")).select("doc", F.expr("variant_get(d, '$.root', 'variant')").alias("v"))
    repo = _kids(top, "o1", ["doc"]).where("tag = 'REPOSITORY'")
    return _normalised(_kids(repo, "o2", ["doc", "o1"]).where("tag = 'FOLDER'"), first_folder_only)


def read_json(spark: SparkSession, path: str, first_folder_only: bool = True) -> Repository:
    """Tables of the JSON document or documents at a path."""
    return from_json(spark.read.text(path, wholetext=True), first_folder_only)


def read_xml(spark: SparkSession, path: str, first_folder_only: bool = True) -> Repository:
    """SRC6: tables of the XML document or documents at a path, in UTF-8; the same as those of the JSON form.

    Documents are split behind each folder, so the folders of one large export are read and parsed in parallel. Text
    between tags says nothing and is dropped. A folder that is no well-formed XML is an error that names its document.
    """
    rows = spark.read.option("lineSep", "</FOLDER>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    held = rows.where(F.col("value").rlike(_FOLDER)).select("file", "block", "at", F.expr(f"substr(value, regexp_instr(value, '{_FOLDER}'))").alias("xml"))
    nodes = held.mapInArrow(_trees, "file string, block long, at long, place int, node string")
    order = F.struct("block", "at", "place")
    node = nodes.select(F.xxhash64("file").alias("doc"), F.lit(0).alias("o1"), order.alias("o2"), F.parse_json("node").alias("v"))
    tagged = node.select("doc", "o1", "o2", F.expr("variant_get(v, '$.tag', 'string')").alias("tag"), F.coalesce(F.expr("variant_get(v, '$.attributes', 'map<string,string>')"), F.expr("cast(map() as map<string,string>)")).alias("a"), "v")
    return _normalised(tagged.where("tag = 'FOLDER'"), first_folder_only)


#: The start of a folder's tag.
_FOLDER = r"<FOLDER[ \t\r\n/>]"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folders of each piece of XML (which lacks its last end tag) as JSON nodes of tag, attributes and children."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for file, block, at, xml in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            top: list[dict] = []
            stack = [top]

            def start(tag: str, attributes: dict, stack: list = stack) -> None:
                node = {"tag": tag, "attributes": attributes, "children": []}
                stack[-1].append(node)
                stack.append(node["children"])

            parser = expat.ParserCreate()
            parser.StartElementHandler, parser.EndElementHandler = start, lambda tag, stack=stack: stack.pop()
            try:
                # A folder without content has no end tag of its own, so it may stand before the one that was cut.
                parser.Parse(f"<ALL>{xml}</FOLDER></ALL>", True)
            except expat.ExpatError as e:
                raise ValueError(f"{file}: no well-formed folder at {block}: {e}") from e
            for place, node in enumerate(top[0]["children"]):
                for column, value in zip(out, (file, block, at, place, json.dumps(node, ensure_ascii=False)), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["file", "block", "at", "place", "node"])


def _normalised(folder: DataFrame, first_folder_only: bool) -> Repository:
    """Tables of folders: doc, o1 and o2 (their order in it), a and v (attributes and node)."""
    # While names are resolved, a folder is its document and its name.
    folder = folder.select(F.struct("doc", attr("NAME").alias("name")).alias("folder"), "doc", "o1", "o2", "v")
    if first_folder_only:
        place = F.row_number().over(Window.partitionBy("doc").orderBy("o1", "o2"))
        folder = folder.select("folder", "v", place.alias("place")).where("place = 1").drop("place")
    l3 = _kids(folder, "o3", ["folder"]).select("folder", "o3", "tag", "a", "v", attr("NAME").alias("name"))
    l3 = _last(l3, ["folder", "tag", "name"], "o3")

    def under(tag: str, *keep: Column) -> DataFrame:
        return _kids(l3.where(F.col("tag") == tag), "o4", ["folder", F.col("name").alias("parent"), F.col("o3").alias("p_ord"), *keep])

    def fields_of(parent: str, tag: str, name: str) -> DataFrame:
        rows = under(parent).where(F.col("tag") == tag)
        return rows.select("folder", F.col("parent").alias(name), attr("NAME").alias("field"), F.col("o4").alias("ord"))

    scopes = l3.where("tag in ('MAPPING', 'MAPPLET')").select("folder", F.col("tag").alias("scope_kind"), F.col("name").alias("scope"), F.col("o3").alias("ord"), "v")
    inner = _kids(scopes, "o4", SCOPE)

    folder_level = l3.where("tag = 'TRANSFORMATION'").select("folder", F.lit("FOLDER").alias("scope_kind"), F.lit("").alias("scope"), F.col("o3").alias("ord"), "a", "v")
    local = inner.where("tag = 'TRANSFORMATION'").select(*SCOPE, F.col("o4").alias("ord"), "a", "v")
    definitions = folder_level.unionByName(local).select(*SCOPE, "ord", attr("NAME").alias("name"), F.coalesce(attr("TYPE"), F.lit("")).alias("type"), "v")
    definitions = _last(definitions, [*SCOPE, "name"], "ord")
    parts = _kids(definitions, "o5", [*SCOPE, F.col("name").alias("transformation")])
    keys = [*SCOPE, "transformation"]
    table_attrs = _bag(parts.where("tag = 'TABLEATTRIBUTE'"), keys, "o5").withColumnRenamed("transformation", "name")
    empty = F.expr("cast(map() as map<string,string>)")
    transformation = definitions.drop("v", "ord").join(table_attrs, [*SCOPE, "name"], "left").select(*SCOPE, "name", "type", F.coalesce("bag", empty).alias("attrs"))

    def with_bag(rows: DataFrame, key: str, tags: list[str], fixed: list[str]) -> DataFrame:
        """Adds attrs: other attributes of the node, overridden by nested attribute nodes."""
        below = _bag(_kids(rows, "o6", [*keys, F.col(key)]).where(F.col("tag").isin(tags)), [*keys, key], "o6")
        joined = rows.join(below, [*keys, key], "left")
        own = F.map_filter("a", lambda k, v: ~k.isin(fixed) & (F.coalesce(v, F.lit("")) != "") & ~F.coalesce(F.array_contains(F.map_keys("bag"), k), F.lit(False)))
        return joined.select(*rows.columns, F.map_concat(own, F.coalesce("bag", empty)).alias("attrs"))

    ports = _last(parts.where("tag = 'TRANSFORMFIELD'").select("*", attr("NAME").alias("port")), [*keys, "port"], "o5")
    ports = with_bag(ports, "port", ["PORTATTRIBUTE", "FIELDATTRIBUTE"], ["NAME", "EXPRESSION", "PORTTYPE", "REF_FIELD", "GROUP"])
    place = F.row_number().over(Window.partitionBy(*keys, "grp").orderBy("ord")) - 1
    port = ports.select(
        *keys, "port", F.col("o5").alias("ord"), F.coalesce(attr("PORTTYPE"), F.lit("")).alias("porttype"), F.coalesce(attr("EXPRESSION"), F.lit("")).alias("expression"),
        attr("REF_FIELD").alias("ref_field"), attr("REF_INSTANCETYPE").alias("ref_instancetype"), attr("GROUP").alias("grp"),
        *[attr(x.upper().replace("_", "")).alias(x) for x in ("datatype", "precision", "scale", "expression_type")], "attrs",
    ).select("*", F.when(F.col("grp").isNotNull(), place).alias("grp_pos"))
    groups = _last(parts.where("tag = 'GROUP'").select("*", attr("NAME").alias("grp")), [*keys, "grp"], "o5")
    groups = with_bag(groups, "grp", ["TABLEATTRIBUTE", "GROUPATTRIBUTE"], ["NAME", "TYPE"])
    port_group = groups.select(*keys, "grp", F.coalesce(attr("TYPE"), F.lit("")).alias("grp_type"), F.col("o5").alias("ord"), "attrs")

    instance = inner.where("tag = 'INSTANCE'").select(*SCOPE, attr("NAME").alias("instance"), attr("TYPE").alias("type"), attr("TRANSFORMATION_NAME").alias("transformation_name"), attr("TRANSFORMATION_TYPE").alias("transformation_type"), F.col("o4").alias("ord"))
    connector = inner.where("tag = 'CONNECTOR'").select(*SCOPE, F.col("o4").alias("ord"), *[attr(f"{side.upper()}{x}").alias(f"{side}_{y}") for side in ("from", "to") for x, y in (("INSTANCE", "instance"), ("FIELD", "field"), ("INSTANCETYPE", "type"))])
    flow = under("WORKFLOW")
    wf = ["folder", F.col("parent").alias("workflow"), F.col("p_ord").alias("wf_ord")]
    task = flow.where("tag = 'TASKINSTANCE'").select(*wf, attr("NAME").alias("task"), attr("TASKTYPE").alias("tasktype"), F.col("o4").alias("ord"))
    session = flow.where("tag = 'SESSION'").select(*wf, attr("NAME").alias("session"), attr("MAPPINGNAME").alias("mapping"), F.col("o4").alias("ord"))
    wlink = flow.where("tag = 'WORKFLOWLINK'").select("folder", F.col("parent").alias("workflow"), attr("FROMTASK").alias("from_task"), attr("TOTASK").alias("to_task"), attr("CONDITION").alias("condition"), F.col("o4").alias("ord"))
    made = Repository(fields_of("SOURCE", "SOURCEFIELD", "source"), fields_of("TARGET", "TARGETFIELD", "target"), transformation, port, port_group, scopes.drop("v"), instance, connector, task, session, wlink)
    return made.map(lambda _, df: df.withColumn("folder", F.col("folder.name")))


def cached(repo: Repository, scratch, tables: Iterable[str] | None = None) -> Repository:
    """The tables, or the named ones alone, written once and read from the shared folder, so documents are parsed a single time."""
    return repo.map(lambda name, df: scratch.write(df, f"repo-{name}") if tables is None or name in tables else df)
