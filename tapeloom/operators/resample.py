"""Session-aware downsampling of bars."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.expr import as_col, utc_midnight
from tapeloom.schema import BAR_COLUMNS, minutes_of

# Exchange time zone, session opens and the split, in minutes of the local day.
EXCHANGE_ZONE = "Asia/Shanghai"
MORNING_OPEN, AFTERNOON_OPEN, NOON = 570, 780, 720


def local_time(ts: Column | str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), as_col(ts))


def session_bucket(ts: Column | str, every: int) -> Column:
    """struct(date, session, bucket); the bucket counts ``every`` minutes from the session open."""
    local = local_time(ts)
    minute = F.hour(local) * 60 + F.minute(local)
    opening = F.when(minute < NOON, F.lit(MORNING_OPEN)).otherwise(F.lit(AFTERNOON_OPEN))
    return F.struct(
        F.to_date(local).alias("date"),
        opening.alias("session"),
        F.floor((minute - opening) / every).alias("bucket"),
    )


def ohlcv() -> list[Column]:
    return [
        F.min_by("open", "timestamp").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"),
    ]


def resample(df: DataFrame, target: str, source: str = "1m") -> DataFrame:
    """Bars of interval ``target``; one hash aggregation with map-side combining."""
    if minutes_of(target) < minutes_of(source):
        raise ValueError(f"cannot resample {source} bars to the finer {target}")
    if target == source:
        return df.select(*BAR_COLUMNS)
    if target == "1d":
        out = (
            df.withColumn("_date", F.to_date(local_time("timestamp")))
            .groupBy("symbol", "_date")
            .agg(*ohlcv())
            .withColumn("timestamp", utc_midnight("_date"))
        )
    else:
        out = (
            df.withColumn("_b", session_bucket("timestamp", minutes_of(target)))
            .select("*", "_b.*")
            .groupBy("symbol", "date", "session", "bucket")
            .agg(F.min("timestamp").alias("timestamp"), *ohlcv())
        )
    return out.withColumn("interval", F.lit(target)).select(*BAR_COLUMNS)
