"""Rows in a form in which results of two engines compare."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def rows_of(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))
