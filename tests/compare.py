"""Rows of Spark and of DuckDB, made comparable."""

import datetime
import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return (v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if v is None else str(v)


def rows(found, columns=None):
    return sorted((tuple(plain(v) for v in r) for r in found), key=str)


def same(df, con, sql):
    columns = sorted(df.columns)
    mine = rows(df.select(*columns).collect())
    theirs = rows(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall())
    assert columns == sorted(con.sql(sql).columns)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, [x for x in zip(mine, theirs) if x[0] != x[1]][:3]
