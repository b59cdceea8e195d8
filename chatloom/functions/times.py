"""Time expressions on micros, so windows are exact whatever the session zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "t": 60_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}


def freq_micros(freq: str) -> int:
    """Micros of a frequency text such as ``5s``, ``60s``, ``6h`` or ``6 hours``."""
    match = re.fullmatch(r"\s*(\d*)\s*([a-z]+)\s*", freq.lower())
    unit = match and match.group(2)
    names = {"second": "s", "seconds": "s", "minute": "min", "minutes": "min", "hour": "h", "hours": "h", "day": "d", "days": "d"}
    unit = names.get(unit, unit)
    if unit not in _UNITS:
        raise ValueError(f"unknown frequency {freq!r}")
    micros = int(match.group(1) or 1) * _UNITS[unit]
    if micros <= 0:
        raise ValueError(f"frequency must be positive: {freq!r}")
    return micros


def micros(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def int_div(left: Column, right: Column | int) -> Column:
    return F.call_function("div", left, right if isinstance(right, Column) else F.lit(right))


def seconds_between(start: Column, end: Column) -> Column:
    return (end - start) / F.lit(1e6)
