"""Runs a registered query and its SQL over the same tables and compares their rows."""

import glob
import math
import os

import duckdb


def connected(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def same(spark, query, sql, folder):
    got = query(spark, folder)
    rel = connected(folder).execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(x) for x in r) for r in rel.fetchall())
    have = sorted(tuple(plain(x) for x in r) for r in got.select(*names).collect())
    assert len(want) == len(have), (len(want), len(have))
    wrong = [(a, b) for a, b in zip(want, have) if a != b]
    assert not wrong, (len(wrong), wrong[:2])
    return len(have)
