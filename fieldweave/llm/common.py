"""Shared pieces: word patterns and blocked prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave import scratch

__all__ = ["Scratch", "blocked_prefix_sum", "word_count", "words_of"]


class Scratch(scratch.Scratch):
    """Intermediate tables whose joins Spark chooses: the corpus operators' limits were measured so."""

    by_size = False


#: What separates words everywhere in this package: space and the control characters 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words of a text as an array; an empty array for null and for texts without words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def blocked_prefix_sum(df: DataFrame, group: list[str], block: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums within `group`, in two levels, so no task sorts more than one block of a hot group.

    `block` is a column whose order agrees with `order`. Per block totals are summed over the (few) blocks
    of a group, then rows add their place inside the block. Adds a column for each name in `sums`.
    """
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(F.col(block).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, block).agg(*[F.sum(c).alias(f"_{k}_total") for k, c in sums.items()])
    totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in [*group, block]], *[F.coalesce(F.sum(f"_{k}_total").over(outer), F.lit(0)).alias(f"_{k}_before") for k in sums])
    rows = df.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_{k}_in") for k, c in sums.items()])
    on = [rows[c].eqNullSafe(totals[f"_g_{c}"]) for c in [*group, block]]
    return rows.join(totals, on, "inner").select(*df.columns, *[(F.col(f"_{k}_in") + F.col(f"_{k}_before")).alias(k) for k in sums])
