"""Compare a registered query with its DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """A value without its engine's type: numbers of equal size are equal."""
    if value is None or isinstance(value, (str, bool, bytes)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value).replace("T", " ").removesuffix(" 00:00:00")
    if math.isnan(number):
        return "nan"
    return float(f"{number:.9g}") + 0.0


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r.asDict(recursive=True).values()) if len(set(df.columns)) == len(df.columns) else tuple(r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = rows_of(names, found.fetchall())
    if got == want:
        return ""
    more, less = got - want, want - got
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list(more)[:2]}; only there {list(less)[:2]}"
