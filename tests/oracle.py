"""Compare a query with its SQL on the same tables, as multisets of rows and with types."""

from __future__ import annotations

from pathlib import Path

import duckdb

KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or nothing."""
    found = con.execute(sql)
    names, kinds = [d[0] for d in found.description], [str(d[1]) for d in found.description]
    mine = sorted(df.columns)
    if mine != sorted(names):
        return f"columns {df.columns} and {names}"
    types = {n: KIND.get(t, t) for n, t in df.dtypes}
    told = dict(zip(names, kinds, strict=True))
    if any(types[c] != told[c] for c in mine):
        return f"types {types} and {told}"
    order = [names.index(c) for c in mine]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*mine).collect()), key=repr)
    if got != want:
        return f"{len(got)} and {len(want)} rows; first of {sum(a != b for a, b in zip(got, want, strict=False))}: " + str(next(((a, b) for a, b in zip(got, want, strict=False) if a != b), ""))
    return ""
