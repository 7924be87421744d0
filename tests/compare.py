"""Compare a registered query with its SQL, the way the driver does: by name, order-free."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.6f}"
    if value is None:
        return "NULL"
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(_cell(row[i]) for i in at) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} against {want_names}"]
    if got == want:
        return []
    extra, lacking = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return [f"{len(got)} rows against {len(want)}", f"extra {extra[:3]}", f"lacking {lacking[:3]}"]
