"""Composable conditions over a feature cross-section.

A condition is a boolean column; combine with ``&`` and ``|``.  ``negate`` first turns an
unknown (NULL) condition into false, so its negation holds.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(column: str, value: float) -> Column:
    return F.col(column) >= value


def at_most(column: str, value: float) -> Column:
    return F.col(column) <= value


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive; an open side is not tested, and no side at all accepts everything."""
    tests = []
    if low is not None:
        tests.append(at_least(column, low))
    if high is not None:
        tests.append(at_most(column, high))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def flag(column: str, equals: bool = True) -> Column:
    return F.col(column) == F.lit(equals)


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def negate(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))
