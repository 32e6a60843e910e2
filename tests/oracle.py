"""Side-by-side comparison of a Spark result with DuckDB SQL over the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> int:
    """Equal column names and equal rows, whatever their order; the number of rows."""
    with duck(sf_dir) as con:
        got = con.execute(sql)
        want = rows_of([c[0] for c in got.description], got.fetchall())
    have = rows_of(df.columns, df.collect())
    assert have[0] == want[0], f"columns: {have[0]} against {want[0]}"
    assert len(have[1]) == len(want[1]), f"rows: {len(have[1])} against {len(want[1])}"
    odd = [(a, b) for a, b in zip(have[1], want[1]) if a != b]
    assert not odd, f"{len(odd)} rows differ, such as {odd[0]}"
    return len(have[1])
