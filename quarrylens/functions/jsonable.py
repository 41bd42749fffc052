"""Plain JSON values of whatever a row holds."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import DataFrame, Row


def jsonable(x):
    """NaN and infinities become null, times ISO texts, keys texts."""
    if isinstance(x, Row):
        x = x.asDict()
    if isinstance(x, dict):
        return {"<MISSING>" if k is None else str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [jsonable(v) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (dt.date, dt.datetime, dt.time)):
        return x.isoformat()
    if isinstance(x, dt.timedelta):
        return x.total_seconds()
    if isinstance(x, (bytes, bytearray)):
        return x.hex()
    return x


def records(df: DataFrame) -> list[dict]:
    """The rows of a frame that is small by nature: a row for each column, category shown, or bin."""
    return [jsonable(r) for r in df.collect()]
