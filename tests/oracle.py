"""Comparison of a query with its SQL on the same Parquet files."""

import datetime
import decimal
import math
import os
from collections import Counter


def even(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(even, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def difference(spark, folder, query, sql):
    """Rows that only one side has: (of the query, of the SQL)."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = Counter(repr(tuple(even(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(repr(tuple(even(r[i]) for i in at)) for r in found.fetchall())
    con.close()
    return mine - theirs, theirs - mine
