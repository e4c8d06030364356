"""Writing reports: CSV, workbooks, JSON of graphs, HTML pages that load their rows by page, and a small self-contained one."""

from __future__ import annotations

import html
import io
import json
import zipfile
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fieldweave.functions.expressions import clean_id
from fieldweave.scratch import Scratch, numbered

HIDDEN = "Transformation Lineage Data"


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """SNK1: header, no index, without the hidden column of hops. One file by default, as reports are read by people."""
    shown = df.select(*[f"`{c}`" for c in df.columns if c != HIDDEN and not c.startswith("_")])
    (shown.coalesce(1) if single_file else shown).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def sheets(report) -> dict[str, DataFrame]:
    """SNK2: the report's tables by sheet name; the mapplets' only where they have rows."""
    out = {"Lineage": report.lineage, "Transformations": report.transformations}
    for name, df in (("Mapplets", report.mapplets), ("Mapplet_Transformations", report.mapplet_transformations)):
        if not df.isEmpty():
            out[name] = df
    return out


def write_sheets(report, folder: str) -> dict[str, str]:
    """SNK2, SNK5: each sheet as CSV below the folder that the caller names, and all of them in one workbook."""
    made, tables = {}, sheets(report)
    for name, df in tables.items():
        made[name] = f"{folder.rstrip('/')}/{name}"
        write_csv(df, made[name])
    made["workbook"] = f"{folder.rstrip('/')}/report.xlsx"
    write_workbook({name: df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")]) for name, df in tables.items()}, made["workbook"])
    return made


class _Stored(io.RawIOBase):
    """A file to write in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()


# The parts and limits of a workbook's format.
SHEET_ROWS, CELL_LETTERS = 1_048_576, 32_767
_MAIN, _RELATION, _PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
# Fixed values end.


def _cell(df: DataFrame, name: str) -> Column:
    """One cell as XML, made by the executors: numbers as such, others as text without what XML can't hold; nulls are empty."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, NumericType):
        return F.coalesce(F.when(value.isNotNull() & ~F.coalesce(F.isnan(value.cast("double")), F.lit(False)), F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>"))), F.lit("<c/>"))
    text = F.regexp_replace(F.substring(value.cast("string"), 1, CELL_LETTERS), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return F.coalesce(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>")), F.lit("<c/>"))


def write_workbook(tables: dict[str, DataFrame], path: str, sheet_rows: int = SHEET_ROWS) -> list[str]:
    """SNK2: one workbook of a sheet a table, in the tables' order; returns the sheets' names.

    Executors make the rows' XML; the driver takes them a partition at a time and packs them as they come, so it never
    holds a table. A table of more rows than a sheet can have goes on in further sheets. Texts longer than a cell can hold
    are cut there, as the format demands; the CSV files have them whole.
    """
    names: list[str] = []
    spark = next(iter(tables.values())).sparkSession
    with io.BufferedWriter(_Stored(spark, path), 1 << 20) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        for name, df in tables.items():
            head = "<row>" + "".join(f'<c t="inlineStr"><is><t>{html.escape(c, False)}</t></is></c>' for c in df.columns) + "</row>"
            rows = (r[0] for r in df.select(F.concat(F.lit("<row>"), *[_cell(df, c) for c in df.columns], F.lit("</row>"))).toLocalIterator())
            row = next(rows, None)
            for part in count(1):
                tail = "" if part == 1 else f" ({part})"
                names.append(name[: 31 - len(tail)] + tail)
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{head}'.encode())
                    held = 1
                    while row is not None and held < sheet_rows:
                        sheet.write(row.encode())
                        held, row = held + 1, next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
                if row is None:
                    break
        numbers = range(1, len(names) + 1)
        put = lambda name, body: book.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{body}')
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATION}"><sheets>{"".join(f"""<sheet name="{html.escape(names[k - 1])}" sheetId="{k}" r:id="r{k}"/>""" for k in numbers)}</sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f"""<Relationship Id="r{k}" Type="{_RELATION}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in numbers)}</Relationships>')
        put("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{"".join(f"""<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPE}.worksheet+xml"/>""" for k in numbers)}</Types>')
    return names


def write_pages(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]], scratch: Scratch, page_rows: int = 1000) -> int:
    """SNK3, LT3: an HTML report with a tab a table, whose rows lie in page files that it loads one by one; returns their number.

    Executors number the rows in the order of the named columns and write the pages; only the files' names come to the
    driver. The filter goes through the pages of a tab one after the other. No table is cut.
    """
    told, pages = [], 0
    for at, (name, df) in enumerate(tables.items()):
        shown = df.select(*[f"`{c}`" for c in df.columns if c != HIDDEN and not c.startswith("_")])
        rows = numbered(shown, [F.col(f"`{c}`") for c in order[name]], "_n", scratch, f"page-{at}")
        cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in shown.columns])
        made = rows.select(((F.col("_n") - 1) / page_rows).cast("long").alias("page"), F.struct(F.col("_n").alias("n"), cells.alias("c")).alias("r"))
        made = made.groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["c"])).alias("body"))
        path = f"{folder.rstrip('/')}/pages/{at}"
        made.select("page", F.concat(F.lit(f"page({at},"), "page", F.lit(","), "body", F.lit(");")).alias("value")).write.mode("overwrite").partitionBy("page").text(path)
        files = {}
        for file in scratch.spark.read.text(path).inputFiles() if not made.isEmpty() else ():
            page = file.rsplit("/page=", 1)[1]
            files[int(page.split("/")[0])] = f"pages/{at}/page={page}"
        told.append({"name": name, "columns": shown.columns, "files": [files[k] for k in sorted(files)]})
        pages += len(files)
    with io.BufferedWriter(_Stored(scratch.spark, f"{folder.rstrip('/')}/index.html")) as file:
        file.write(_PAGED.replace("TOLD", json.dumps(told).replace("</", "<\\/")).encode())
    return pages


_PAGED = """<!doctype html><meta charset="utf-8"><title>Field lineage</title><h1>Field lineage</h1><nav id="tabs"></nav><input id="q" placeholder="filter, then Enter"><button id="b">&lt;</button><span id="p"></span><button id="f">&gt;</button><table id="t"></table><script>
const told=TOLD,held={},wait={},E=i=>document.getElementById(i);let tab=0,at=0;
function page(s,k,rows){held[s+'/'+k]=rows;(wait[s+'/'+k]||(()=>{}))()}
function load(s,k){return new Promise(done=>{if(held[s+'/'+k])return done(held[s+'/'+k]);wait[s+'/'+k]=()=>done(held[s+'/'+k]);const x=document.createElement('script');x.src=told[s].files[k];document.head.append(x)})}
function fill(rows){const t=E('t');t.textContent='';for(const r of [told[tab].columns,...rows]){const x=t.insertRow();for(const v of r){x.insertCell().textContent=v}}}
async function show(){const n=told[tab].files.length;E('p').textContent=n?` ${at+1} / ${n} `:' no rows ';fill(n?await load(tab,at):[])}
async function find(){const q=E('q').value.toLowerCase();if(!q)return show();let found=[];for(let k=0;k<told[tab].files.length;k++){const key=tab+'/'+k,had=held[key],rows=await load(tab,k);found=found.concat(rows.filter(r=>r.some(v=>v.toLowerCase().includes(q))));if(!had)delete held[key]}fill(found);E('p').textContent=` ${found.length} rows `}
told.forEach((s,k)=>{const b=document.createElement('button');b.textContent=s.name;b.onclick=()=>{tab=k;at=0;show()};E('tabs').append(b)});
E('b').onclick=()=>{at=Math.max(0,at-1);show()};E('f').onclick=()=>{at=Math.min(told[tab].files.length-1,at+1);show()};E('q').onkeydown=e=>{if(e.key==='Enter')find()};show();</script>"""


def with_row_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """SNK4: a column row_id from the named columns."""
    return df.withColumn("row_id", clean_id(*[F.col(f"`{c}`").cast("string") for c in columns]))


def html_page(report, max_rows: int = 100_000) -> str:
    """SNK3: a page with a table a sheet and a text filter; rows are embedded, so at most `max_rows` a sheet, and its heading says so where there are more (see write_pages)."""
    parts = []
    for name, df in sheets(report).items():
        shown = df.select(*[f"`{c}`" for c in df.columns if c != HIDDEN and not c.startswith("_")]).limit(max_rows + 1)
        rows = [json.loads(x[0]) for x in shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        heading = name if len(rows) <= max_rows else f"{name} (the first {max_rows:,} rows of more)"
        parts.append({"name": heading, "columns": shown.columns, "rows": [[r[c] for c in shown.columns] for r in rows[:max_rows]]})
    data = json.dumps(parts).replace("</", "<\\/")
    title = html.escape("Field lineage")
    return f"""<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><input id="q" placeholder="filter"><div id="t"></div><script>
const data={data};
const cell=v=>{{const d=document.createElement('td');d.textContent=v===null?'':v;return d}};
function show(){{const q=document.getElementById('q').value.toLowerCase(),t=document.getElementById('t');t.textContent='';
for(const s of data){{const h=document.createElement('h2'),b=document.createElement('table');h.textContent=s.name;
const head=b.insertRow();s.columns.forEach(c=>head.append(cell(c)));
s.rows.filter(r=>r.some(v=>String(v??'').toLowerCase().includes(q))).forEach(r=>{{const x=b.insertRow();r.forEach(v=>x.append(cell(v)))}});t.append(h,b)}}}}
document.getElementById('q').oninput=show;show();</script>"""


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text as a file below `path`, through Spark's writer."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
