"""Side-by-side run of a query and its SQL."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).isoformat()
    return v


def rows_of(rows, columns):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    ours = rows_of(df.collect(), df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of([dict(zip(names, r)) for r in cursor.fetchall()], names)
    assert sorted(names) == sorted(df.columns)
    assert len(ours) == len(theirs)
    assert ours == theirs
