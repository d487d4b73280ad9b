"""Rows of a query and of its SQL, compared as bags of values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def compare(spark: SparkSession, sf_dir: str, query, sql: str) -> tuple[int, int, list]:
    """(rows of Spark, rows of SQL, some differences)."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = connection(sf_dir).execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    a, b = Counter(ours), Counter(theirs)
    diff = [("spark", x) for x in list((a - b).elements())[:3]] + [("sql", x) for x in list((b - a).elements())[:3]]
    return len(ours), len(theirs), diff
