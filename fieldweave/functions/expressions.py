"""Expression text, ports and hops, as Column expressions (no Python functions run on rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
LOOKUP_CALL = r"(?i):LKP\.(\w+)\s*\(([^)]*)\)"
# Words of the expression language, never taken for ports.
KEYWORDS = (
    "IIF", "DECODE", "TRUE", "FALSE", "AND", "OR", "NOT", "NULL", "ISNULL", "IS", "IN", "TO_DATE", "TO_CHAR", "TO_DECIMAL", "TO_INTEGER", "TO_FLOAT",
    "SUBSTR", "TRIM", "LTRIM", "RTRIM", "UPPER", "LOWER", "CONCAT", "LENGTH", "ROUND", "TRUNC", "ABS", "SYSDATE", "SYSTIMESTAMP", "ADD_TO_DATE", "DATE_DIFF", "INSTR",
    "REPLACESTR", "REPLACECHR", "LPAD", "RPAD", "MAX", "MIN", "SUM", "COUNT", "AVG", "FIRST", "LAST", "NEXTVAL", "CURRVAL", "ERROR", "ABORT", "IFNULL", "COALESCE",
    "REG_EXTRACT", "REG_MATCH", "REG_REPLACE", "LKP",
)
INPUT_TYPES, OUTPUT_TYPES = ("input transformation", "mapplet input"), ("output transformation", "mapplet output")
# Fixed values end.
HOP = "struct<name:string,type:string,field:string,label:string>"


def tokens(expr: Column) -> Column:
    """distinct names in an expression in order of first appearance, without keywords."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(expr, F.lit("")), F.lit(TOKEN), F.lit(0))), lambda t: ~F.upper(t).isin(*KEYWORDS))


def lookup_calls(expr: Column) -> Column:
    """calls of unconnected lookups as an array of (name, args)."""
    text = F.coalesce(expr, F.lit(""))
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(LOOKUP_CALL), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(LOOKUP_CALL), F.lit(2)).alias("args"))


def names_whole_word(expr: Column, name: Column) -> Column:
    """whether an expression names a port as a whole word."""
    return F.regexp_like(expr, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))


def short(expr: Column, n: int = 70) -> Column:
    """LT4: white space collapsed, at most n characters."""
    e = F.trim(F.regexp_replace(F.coalesce(expr, F.lit("")), r"[ \t\r\n\x0B\f]+", " "))
    return F.when(F.length(e) > n, F.concat(F.substring(e, 1, n - 3), F.lit("..."))).otherwise(e)


def _named(name: str):
    return lambda e: e["k"] == name.strip().lower()


def first_attr(attrs: Column, *names: str) -> Column:
    """PF13: the first attribute that isn't blank, keys compared trimmed and in lower case; null if there is none."""
    known = F.transform(F.filter(F.map_entries(attrs), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v")))
    return F.coalesce(*[F.try_element_at(F.transform(F.filter(known, _named(n)), lambda e: e["v"]), F.lit(-1)) for n in names])


def hop(name: Column, type_: Column, field: Column, label: Column) -> Column:
    """a hop of a path. Hops are carried as structs, so labels are never parsed."""
    return F.struct(name.alias("name"), type_.alias("type"), field.alias("field"), label.alias("label"))


def grouped_hops(hops: Column) -> Column:
    """of consecutive hops of one name and type, the first in target-first order."""
    return F.filter(hops, lambda h, i: (i == 0) | ~((h["name"] == F.get(hops, i - 1)["name"]) & (h["type"] == F.get(hops, i - 1)["type"])))


def chain(hops: Column) -> Column:
    """`name.field[type] -> ...` from source to target."""
    shown = lambda h: F.concat(h["name"], F.when(F.coalesce(h["field"], F.lit("")) != "", F.concat(F.lit("."), h["field"])).otherwise(F.lit("")), F.lit("["), h["type"], F.lit("]"))
    return F.array_join(F.transform(F.reverse(grouped_hops(hops)), shown), " -> ")


def chain_by_type(hops: Column) -> Column:
    """the shorter chain, `name[type] -> ...`, adjacent equals collapsed."""
    shown = F.transform(F.reverse(hops), lambda h: F.concat(h["name"], F.lit("["), h["type"], F.lit("]")))
    return F.array_join(F.filter(shown, lambda x, i: (i == 0) | (x != F.get(shown, i - 1))), " -> ")


def chain_data(hops: Column, mapping: Column) -> Column:
    """SNK8: the chain's hops as JSON."""
    return F.to_json(F.transform(F.reverse(grouped_hops(hops)), lambda h: F.struct(h["name"].alias("name"), h["type"].alias("type"), F.coalesce(h["field"], F.lit("")).alias("field"), mapping.alias("mapping"), F.lit("mapping").alias("scope"))))


def category(expr: Column) -> Column:
    """F8."""
    return F.when(F.coalesce(expr, F.lit("")) == "", "Direct Pass through").otherwise("Involves Derivation")


def port_class(port: Column, porttype: Column, expr: Column) -> Column:
    """a struct of is_in, is_out and is_var."""
    up, blank = F.upper(F.coalesce(porttype, F.lit(""))), F.coalesce(expr, F.lit("")) == ""
    is_in, is_out = up.contains("INPUT"), up.contains("OUTPUT")
    is_var = up.contains("VARIABLE") | F.lower(port).rlike("^(v_|i_|o_)")
    none = ~(is_in | is_out | is_var)
    return F.struct((is_in | (none & blank)).alias("is_in"), is_out.alias("is_out"), (is_var | (none & ~blank)).alias("is_var"))


def business_logic(ttype: Column, attrs: Column, port_attrs: Column, grp: Column, grp_attrs: Column, closure: Column) -> tuple[Column, Column]:
    """a port's business logic and further information by type; the closure's text where an attribute is blank."""
    t = F.upper(F.coalesce(ttype, F.lit("")))
    a = lambda *names: first_attr(attrs, *names)
    told = lambda label, value: F.concat(F.lit(label), value)
    lines = lambda sep, *parts: F.nullif(F.concat_ws(sep, *parts), F.lit(""))
    rest = F.filter(F.map_entries(attrs), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & (F.lower(F.trim(e["key"])) != "stored procedure name"))
    ranks = (a("Top/Bottom", "Top Bottom"), a("Number Of Ranks"))
    rules: list[tuple[Column, Column, Column]] = [
        (t.contains("EXPRESSION") | t.contains("AGGREGATOR"), F.lit(None), F.lit("")),
        (t.contains("FILTER"), a("Filter Condition"), F.lit("")),
        (t.contains("JOINER"), a("Join Condition"), a("Join Type")),
        (t.contains("LOOKUP"), lines("\n", told("Lookup Condition: ", a("Lookup Condition")), told("Lookup Sql Override: ", a("Lookup Sql Override", "Lookup Sql Overide")), told("Lookup Table Name: ", a("Lookup table name"))), a("Connection Information")),
        (t.contains("ROUTER"), lines("\n", told("Group Name: ", grp), told("Group Filter Condition: ", first_attr(grp_attrs, "Group Filter Condition", "Filter Condition", "Condition"))), F.lit("")),
        (t.contains("SEQUENCE"), a("Current Value"), lines("; ", *[told(f"{x}: ", a(x)) for x in ("Start Value", "Increment Value", "End Value")])),
        (t.contains("SORTER"), F.coalesce(first_attr(port_attrs, "Sort Direction"), a("Sort Direction")), a("Transformation Scope")),
        (t.contains("SOURCE QUALIFIER") | (t == "SQ"), a("Sql Query", "Sql Override"), lines("; ", told("User Defined Join: ", a("User Defined Join")), told("Source Filter: ", a("Source Filter")), told("Associated source definitions: ", a("Associated Source Instance", "Associated Source Definitions", "Source Table Name")))),
        (t.contains("STORED PROCEDURE"), a("Stored Procedure Name"), F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")),
        (t.contains("TRANSACTION"), a("Transaction Control Condition"), F.lit("")),
        (t.contains("UPDATE STRATEGY"), a("Update Strategy Expression"), F.lit("")),
        (t.contains("RANK"), F.when(ranks[0].isNotNull() | ranks[1].isNotNull(), F.concat(F.lit("Rank="), F.coalesce(ranks[0], F.lit("")), F.lit(", number of Ranks="), F.coalesce(ranks[1], F.lit("")))), a("Case-Sensitive String Comparison", "Case Sensitive String Comparison")),
    ]
    logic, more = closure, F.lit("")
    for when, text, info in reversed(rules):
        logic, more = F.when(when, F.coalesce(text, closure)).otherwise(logic), F.when(when, F.coalesce(info, F.lit(""))).otherwise(more)
    return logic, more


def instance_kind(type_: Column) -> Column:
    """a connector's instance type as SOURCE, TARGET, MAPPLET or TRANSFORMATION."""
    t = F.lower(F.trim(F.coalesce(type_, F.lit(""))))
    return F.when(t.contains("source definition") | (t == "source"), "SOURCE").when(t.contains("target definition") | (t == "target"), "TARGET").when(t == "mapplet", "MAPPLET").otherwise("TRANSFORMATION")


def dependency(crossings: Column) -> Column:
    """F13."""
    return F.when(crossings <= 1, "Direct").otherwise("Indirect")


def clean_id(*parts: Column) -> Column:
    """F16 and SNK4: parts joined by `_`, all but letters, digits, `_` and `-` replaced."""
    return F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9_-]", "_")


def node_id(kind: Column, scope: Column, instance: Column, field: Column) -> Column:
    """F17."""
    return F.concat(kind, F.lit(":"), scope, F.lit("::"), instance, F.lit("::"), field)
