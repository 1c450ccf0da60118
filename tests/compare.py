"""Rows of a query and of its SQL in one comparable form."""

import math


def normal(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
                cells.append("null")
            elif isinstance(v, float) and v == int(v) and abs(v) < 1e15:
                cells.append(str(int(v)))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def agree(spark, duck, query, sql, folder):
    got, want = query(spark, folder).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
