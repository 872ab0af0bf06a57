"""Rows of two engines as comparable text."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(str, (tuple(plain(r[i]) for i in order) for r in rows)))


def assert_same(df, relation):
    names = [x[0] for x in relation.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, relation.fetchall())
