"""Compare a query with its SQL: same columns, same rows whatever their order."""

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def differences(con, df, sql):
    """(columns agree, rows only in the query, rows only in the SQL)."""
    cols = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = Counter(tuple(_plain(r[names.index(c)]) for c in cols if c in names) for r in res.fetchall())
    return sorted(names) == cols, ours - theirs, theirs - ours
