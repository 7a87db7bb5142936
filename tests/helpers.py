from __future__ import annotations

import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def spark_rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr), cols


def duck_rows(con, sql, cols):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    idx = [names.index(c) for c in cols]
    return sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr), names
