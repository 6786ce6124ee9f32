"""Run a named query and its SQL side by side and say how they differ."""

from __future__ import annotations

import math
import os

import duckdb

ROOT = os.environ.get("FATHOMLINE_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(df, con, sql: str) -> str | None:
    names = sorted(df.columns)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), "?") for f in df.schema}
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    clash = {n: (kinds[n], theirs[n]) for n in names if kinds[n] != theirs[n]}
    if clash:
        return f"types {clash}"
    ours = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    wanted = ", ".join(f'"{n}"' for n in names)
    expected = sorted(con.sql(f"SELECT {wanted} FROM ({sql}) q").fetchall(), key=_key)
    if len(ours) != len(expected):
        return f"{len(ours)} rows against {len(expected)}"
    for a, b in zip(ours, expected):
        if not all(_same(x, y) for x, y in zip(a, b)):
            bad = sum(
                not all(_same(x, y) for x, y in zip(p, q)) for p, q in zip(ours, expected)
            )
            return f"{bad} rows differ, first {dict(zip(names, a))} against {dict(zip(names, b))}"
    return None
