"""Column expressions shared by the operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the end of an interval that is still open.
OPEN_END = dt.date(9999, 12, 31)


def open_end(end: Column) -> Column:
    """An interval end with NULL read as "still open"."""
    return F.coalesce(end, F.lit(OPEN_END))


def date_key(day: Column) -> Column:
    """Calendar key ``yyyyMMdd`` as int, by arithmetic so that it stays inside codegen."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns; NULLs and separators inside values cannot collide.

    Every value is written as its length and text, NULL as a bare marker.
    """
    texts = [F.col(c).cast("string") for c in columns]
    parts = [
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
        for text in texts
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def any_differs(left: str, right: str, columns: list[str]) -> Column:
    """True where at least one column differs between two aliases, NULL-safe."""
    tests = [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def interleave_bits(columns: list[Column], bits: int) -> Column:
    """Morton (Z-order) key of non-negative integer columns, ``bits`` bits from each."""
    if bits * len(columns) > 62:
        raise ValueError("the interleaved key must fit into 62 bits")
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for place, column in enumerate(columns):
            picked = F.shiftright(column.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(picked, bit * len(columns) + place))
    return key
