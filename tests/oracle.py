"""Compare a registered query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_value(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return x


def _sorted(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    done = con.execute(sql)
    names = [x[0] for x in done.description]
    return sorted(names), _sorted(names, done.fetchall())


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if the rows are the same; else the first difference."""
    names, want = sql_rows(sql, sf_dir)
    got = _sorted(df.columns, df.collect())
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    return next((f"{a} != {b}" for a, b in zip(got, want, strict=True) if a != b), "")
