"""Workbooks read back from their parts, and paged reports from their page files."""

import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from fieldweave.scratch import Scratch
from fieldweave.sources import sinks

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def cells(book, k):
    rows = ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).findall(".//m:row", NS)
    return [["".join(c.itertext()) for c in r.findall("m:c", NS)] for r in rows]


def test_workbook(spark, tmp_path):
    one = spark.createDataFrame([(1, "a < b & \"c\"", 1.5), (2, "  日本\x00\n", None), (None, None, float("nan")), (4, "x" * 40_000, 2.0)], "`id & n` int, t string, d double").coalesce(1)
    many = spark.range(25).select(F.col("id"), F.concat(F.lit("r"), "id").alias("name")).coalesce(3)
    names = sinks.write_workbook({"One": one, "A name of more than thirty-one letters": many, "None": many.limit(0)}, str(tmp_path / "b.xlsx"), sheet_rows=11)
    assert names == ["One", "A name of more than thirty-one ", "A name of more than thirty- (2)", "A name of more than thirty- (3)", "None"]
    with zipfile.ZipFile(tmp_path / "b.xlsx") as book:
        assert book.testzip() is None
        shown = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
        assert shown == names and {"[Content_Types].xml", "_rels/.rels", "xl/_rels/workbook.xml.rels"} <= set(book.namelist())
        got = cells(book, 1)
        assert got[:4] == [["id & n", "t", "d"], ["1", "a < b & \"c\"", "1.5"], ["2", "  日本\n", ""], ["", "", ""]] and len(got[4][1]) == 32_767
        rows = [r for k in (2, 3, 4) for r in cells(book, k)[1:]]
        assert rows == [[str(k), f"r{k}"] for k in range(25)] and cells(book, 5) == [["id", "name"]]


def test_pages(spark, tmp_path):
    """Every row is in one page, in order; the index names every page's file."""
    rows = spark.range(2500).select((F.lit(2500) - F.col("id")).alias("n"), F.concat(F.lit("</script> \"é"), "id").alias("t"), F.lit("h").alias(sinks.HIDDEN)).repartition(7)
    assert sinks.write_pages({"Rows": rows, "Empty": rows.limit(0)}, str(tmp_path), {"Rows": ["n"], "Empty": ["n"]}, Scratch(spark), page_rows=400) == 7
    page = (tmp_path / "index.html").read_text(encoding="utf-8")
    told = json.loads(re.search(r"const told=(.*),held=", page)[1].replace("<\\/", "</"))
    assert [t["name"] for t in told] == ["Rows", "Empty"] and told[0]["columns"] == ["n", "t"] and told[1]["files"] == []
    got = []
    for k, file in enumerate(told[0]["files"]):
        body = open(f"{tmp_path}/{file}", encoding="utf-8").read().strip()
        assert body.startswith(f"page(0,{k},") and body.endswith(");")
        got += json.loads(body[len(f"page(0,{k},") : -2])
    assert got == [[str(n), f"</script> \"é{2500 - n}"] for n in range(1, 2501)]
