"""Bar layout and the interval vocabulary."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLUMNS = ("symbol", "interval", "timestamp", "open", "high", "low", "close", "volume")

# Minutes covered by one bar of each interval.
INTERVAL_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "1d": 1440}

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("interval", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(name, T.DoubleType()) for name in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()),
    ]
)

STORED_SCHEMA = T.StructType([*BAR_SCHEMA.fields, T.StructField("ingested_at", T.TimestampNTZType())])


def minutes_of(interval: str) -> int:
    if interval not in INTERVAL_MINUTES:
        raise ValueError(f"unknown interval {interval!r}; known: {sorted(INTERVAL_MINUTES)}")
    return INTERVAL_MINUTES[interval]


def interval_minutes(interval: Column | str) -> Column:
    """Minutes of an interval label; NULL for a label outside the vocabulary."""
    pairs = [F.lit(v) for item in INTERVAL_MINUTES.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), F.col(interval) if isinstance(interval, str) else interval)


def is_intraday(interval: Column | str) -> Column:
    return interval_minutes(interval) < F.lit(INTERVAL_MINUTES["1d"])
