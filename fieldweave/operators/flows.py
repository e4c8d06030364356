"""The set-changing transformations of analysed pipelines as DataFrame steps: router, normalizer, update strategy.

A catalogued router, normalizer or update strategy says what its pipeline does to rows; these do it. Each is one scan of
its rows: the router tags a row with all groups it belongs to, the normalizer unfolds repeated columns, and the update
strategy orders a key's changes behind its row of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "DEFAULT"
# What an update strategy's expression gives a row.
INSERT, UPDATE, DELETE, REJECT = 0, 1, 2, 3
# Fixed values end.


def route(rows: DataFrame, groups: dict[str, Column], column: str = "group") -> DataFrame:
    """Router: every row once for each group whose condition holds, and under `DEFAULT` if none does.

    A condition that is null does not hold. The input is read once, however many groups there are; write the result by
    `partitionBy(column)` to have each group apart.
    """
    if DEFAULT in groups or column in rows.columns:
        raise ValueError(f"{DEFAULT} names the rows of no group, and {column} must be a new column")
    met = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in groups.items()])) if groups else F.array().cast("array<string>")
    return rows.select("*", F.explode(F.when(F.size(met) > 0, met).otherwise(F.array(F.lit(DEFAULT)))).alias(column))


def normalize(rows: DataFrame, keep: list[str], occurs: dict[str, list[str]], gk: str = "gk", gcid: str = "gcid", keep_empty: bool = False) -> DataFrame:
    """Normalizer: a row for each occurrence of repeated columns, with its number (from 1) and the key of its input row.

    `occurs` names each output column's input columns, as many for each. The generated key is unique, not gapless: numbers
    without gaps would need a total order of the rows. Occurrences whose columns are all null are left out, unless kept.
    """
    sizes = {len(c) for c in occurs.values()}
    if len(sizes) != 1 or 0 in sizes:
        raise ValueError("every repeated column needs the same number of occurrences")
    times = sizes.pop()
    parts = F.array(*[F.struct(F.lit(k + 1).alias(gcid), *[F.col(c[k]).alias(name) for name, c in occurs.items()]) for k in range(times)])
    # The key is made before the rows unfold.
    out = rows.select("*", F.monotonically_increasing_id().alias(gk)).select(*keep, gk, F.explode(parts).alias("_part")).select(*keep, gk, "_part.*")
    return out if keep_empty else out.dropna("all", subset=list(occurs))


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], flag: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Update strategy: (the table after the changes, the rejected changes with a column reason).

    `changes` have the table's columns and in `flag` what each does: insert, update or delete, else it is rejected
    (`flagged`). Changes of one key take effect one after the other, by `order`: an insert of a key that is there is rejected
    (`present`), and an update or delete of one that isn't (`absent`). Whether it is there follows from the last insert or
    delete before, applied or not, or else from the table, so no change waits for another. A change whose key has a null
    part is rejected (`no key`); such rows of the table stay. Keys of the table are unique.

    One shuffle by key, of both sides together; a key's changes are sorted in one task, and stream through it.
    """
    columns = table.columns
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    what = F.when(F.col(flag).isin(INSERT, UPDATE, DELETE), F.col(flag))
    reason = F.when(what.isNull(), "flagged").when(~whole, "no key")
    both = changes.select(*changes.columns, F.lit(1).alias("_side"), reason.alias("reason"), what.cast("int").alias("_what"))
    kept = table.where(whole).select(*columns, *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in changes.columns if c not in columns], F.lit(0).alias("_side"), F.lit(None).cast("string").alias("reason"), F.lit(INSERT).alias("_what"))
    rows = both.where("reason is null").unionByName(kept)
    turn = Window.partitionBy(*keys).orderBy("_side", *order)
    there = F.last(F.when(F.col("_what") == INSERT, True).when(F.col("_what") == DELETE, False), ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    applies = F.when(F.col("_what") == INSERT, ~F.coalesce(there, F.lit(False))).otherwise(F.coalesce(there, F.lit(False)))
    told = rows.select("*", applies.alias("_applies"), F.row_number().over(turn).alias("_turn"))
    last = F.max(F.when(F.col("_applies"), F.col("_turn"))).over(Window.partitionBy(*keys))
    told = told.withColumn("_last", last)
    new = told.where(F.col("_applies") & (F.col("_turn") == F.col("_last")) & (F.col("_what") != DELETE)).select(*columns)
    clash = told.where(~F.col("_applies")).select(*changes.columns, F.when(F.col("_what") == INSERT, "present").otherwise("absent").alias("reason"))
    rejected = both.where("reason is not null").select(*changes.columns, "reason").unionByName(clash)
    return new.unionByName(table.where(~whole)), rejected
