"""Runs SQL over the parquet tables and compares tables without regard to row order."""

from __future__ import annotations

import os

import duckdb


def run_sql(sql: str, folder: str) -> list[dict]:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{file}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]


def normal(rows: list[dict]) -> list[tuple]:
    def one(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted(((*[(k, one(r[k])) for k in sorted(r)],) for r in rows), key=repr)
