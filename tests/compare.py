"""Rows of a query and of its DuckDB SQL, made comparable."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(names: list[str], found: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([(names[k], _plain(r[k])) for k in order]) for r in found)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def difference(spark, sf_dir: str, query, sql: str, con) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    a = rows(df.columns, df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    b = rows(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if a == b:
        return ""
    extra, missing = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} rows and {len(b)}; only Spark {extra[:2]}, only SQL {missing[:2]}"
