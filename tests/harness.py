"""Run a Spark query and its DuckDB twin and compare them as sorted, typed rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else round(v, 6))
    if isinstance(v, int):
        return ("i", v)
    return (type(v).__name__, v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_value(r[i]) for i in order) for r in rows], key=repr)


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
}


def differences(df, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    result = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in result.description}
    duck_columns = [d[0] for d in result.description]
    theirs = _rows(duck_columns, result.fetchall())
    if sorted(df.columns) != sorted(duck_columns):
        return f"columns {sorted(df.columns)} != {sorted(duck_columns)}"
    wrong = {c: (t, duck_types[c]) for c, t in df.dtypes if _TYPES.get(t) != duck_types[c]}
    if wrong:
        return f"types {wrong}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return (
        f"rows {len(ours)} != {len(theirs)}; columns {sorted(df.columns)}; "
        f"only ours {sorted(a - b, key=repr)[:2]}; only theirs {sorted(b - a, key=repr)[:2]}"
    )
