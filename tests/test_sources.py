"""The XML form of repository documents against the JSON form."""

import json
from dataclasses import fields
from xml.sax.saxutils import quoteattr

import pytest

from fieldweave.sources.compact import document
from fieldweave.sources.repository import read_json, read_xml
from fieldweave.sources.sample import ENGINE_B, GOLDEN

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE POWERMART SYSTEM "powrmart.dtd">\n<POWERMART CREATION_DATE="x">\n'


def xml(node, depth=0):
    attributes = "".join(f" {k} ={quoteattr(v)}" for k, v in node["attributes"].items())
    inside = "".join(xml(c, depth + 1) for c in node["children"])
    pad = "    " * depth
    return f"{pad}<{node['tag']}{attributes}>\n{inside}{pad}<!-- told -->text &amp; more</{node['tag']}>\n" if node["children"] else f"{pad}<{node['tag']}{attributes}/>\n"


def rows(repo):
    return {f.name: sorted((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in getattr(repo, f.name).collect())) for f in fields(repo)}


@pytest.mark.parametrize("first_only", [True, False])
def test_same_tables(spark, tmp_path, first_only):
    hard = 'FOLDER{NAME=G}[SOURCE{NAME=ü < & " \' 日本}[SOURCEFIELD{NAME=a>b}] MAPPING{NAME=m}[TRANSFORMATION{NAME=E;TYPE=Expression}[TRANSFORMFIELD{NAME=P;PORTTYPE=OUTPUT;EXPRESSION=IIF(a < 1 AND b > 2, \'x\', "y")}]]]'
    for k, text in enumerate((f"{GOLDEN} {ENGINE_B.replace('NAME=F', 'NAME=F2', 1)} {hard}", hard, f"FOLDER{{NAME=EMPTY}} {GOLDEN}")):
        tree = json.loads(document(text))
        (tmp_path / f"d{k}.json").write_text(json.dumps(tree))
        (tmp_path / f"d{k}.xml").write_text(HEAD + "".join(xml(c) for c in tree["root"]["children"]) + "</POWERMART>\n")
    got, want = (rows(read(spark, str(tmp_path / f"*.{kind}"), first_only)) for read, kind in ((read_xml, "xml"), (read_json, "json")))
    assert got == want and len(got["port"]) > 5 and (first_only or any("\\u65e5" in r for r in got["source_field"]))


def test_many_folders_over_splits(spark, tmp_path):
    """A document larger than a split: every folder is read once, in order."""
    folders = "".join(f'<FOLDER NAME="F{k}"><SOURCE NAME="S"><SOURCEFIELD NAME="A{k}"/>{"<!-- " + "x" * 500 + " -->"}</SOURCE></FOLDER>\n' for k in range(300))
    (tmp_path / "big.xml").write_text(f'{HEAD}<REPOSITORY NAME="R">{folders}</REPOSITORY></POWERMART>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        every = read_xml(spark, str(tmp_path / "big.xml"), False).source_field.collect()
        first = read_xml(spark, str(tmp_path / "big.xml")).source_field.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["folder"], r["field"]) for r in every) == sorted((f"F{k}", f"A{k}") for k in range(300))
    assert [(r["folder"], r["field"]) for r in first] == [("F0", "A0")]


def test_broken_and_empty_documents(spark, tmp_path):
    (tmp_path / "none.xml").write_text('<POWERMART><REPOSITORY NAME="R"/></POWERMART>')
    assert read_xml(spark, str(tmp_path / "none.xml")).scope.count() == 0
    (tmp_path / "broken.xml").write_text('<POWERMART><REPOSITORY><FOLDER NAME="F"><MAPPING></FOLDER></REPOSITORY></POWERMART>')
    with pytest.raises(Exception, match="broken.xml"):
        read_xml(spark, str(tmp_path / "broken.xml")).scope.count()
