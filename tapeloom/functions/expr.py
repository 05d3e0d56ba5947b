"""Column helpers shared by every operator."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ieee_div(num: Column | str, den: Column | str) -> Column:
    """Double division with IEEE results: x/0 is +-inf, 0/0 is NaN, NULL stays NULL."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    by_zero = (
        F.when(n > 0, F.when(F.isnan(n), F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
        .when(n < 0, F.lit(float("-inf")))
        .when(n == 0, F.lit(float("nan")))
    )
    return F.when(d == 0, by_zero).otherwise(n / d)


def finite(c: Column | str) -> Column:
    """NULL in place of NaN and infinities."""
    x = as_col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def epoch_minutes(ts: Column | str) -> Column:
    return F.timestamp_diff("MINUTE", F.expr(EPOCH), as_col(ts))


def utc_midnight(day: Column | str) -> Column:
    return as_col(day).cast("timestamp_ntz")
