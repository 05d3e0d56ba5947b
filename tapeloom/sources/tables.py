"""The stored bars table: create, append, read, deduplicate, inspect."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.resample import resample
from tapeloom.schema import BAR_COLUMNS, STORED_SCHEMA, minutes_of

KEY = ("symbol", "interval", "timestamp")
MONTH = "yyyy-MM"


def create_bars_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Parquet table partitioned by interval and month; a no-op when it exists."""
    fields = [f for f in STORED_SCHEMA.fields if f.name != "interval"]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, interval string, month string) "
        f"USING parquet PARTITIONED BY (interval, month){where}"
    )


def check_bar_columns(df: DataFrame) -> None:
    missing = sorted(set(BAR_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing bar columns: {missing}")


def for_storage(df: DataFrame) -> DataFrame:
    """Bar columns plus ``ingested_at`` and ``month``, one balanced write task per file."""
    check_bar_columns(df)
    stamp = F.col("ingested_at") if "ingested_at" in df.columns else F.localtimestamp()
    fields = [F.col(f.name).cast(f.dataType) for f in STORED_SCHEMA if f.name not in ("interval", "ingested_at")]
    return (
        df.select(
            *fields,
            stamp.alias("ingested_at"),
            "interval",
            F.date_format("timestamp", MONTH).alias("month"),
        )
        .hint("rebalance", "interval", "month")
        .sortWithinPartitions("interval", "month", "symbol", "timestamp")
    )


def write_bars(df: DataFrame, table: str) -> int:
    """Append to the table and return the number of rows, counted during the write."""
    seen = Observation()
    out = for_storage(df).observe(seen, F.count(F.lit(1)).alias("rows"))
    out.write.mode("append").insertInto(table)
    return int(seen.get["rows"])


def save_bucketed(df: DataFrame, table: str, buckets: int, location: str | None = None) -> None:
    """Bars as a catalog table whose files hold whole symbols in order of time.

    Windows, aggregates and joins by symbol over the table need no exchange.  The rows are
    dealt by bucket first, so every bucket is one file and stays sorted.
    """
    check_bar_columns(df)
    dealt = df.select(*BAR_COLUMNS).repartition(buckets, "symbol")
    out = dealt.write.format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", "timestamp")
    if location:
        out = out.option("path", location)
    out.saveAsTable(table)


def read_bars(
    bars: DataFrame,
    symbols: Sequence[str] | None = None,
    interval: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    dedup: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Bars with ``start <= timestamp < end``; filters reach the scan and the partitions."""
    ts = F.col("timestamp")
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    if interval is not None:
        minutes_of(interval)
        bars = bars.where(F.col("interval") == interval)
    for bound, keep_row, keep_month in (
        (start, lambda b: ts >= b, lambda m: F.col("month") >= m),
        (end, lambda b: ts < b, lambda m: F.col("month") <= m),
    ):
        if bound is None:
            continue
        bars = bars.where(keep_row(F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")))
        if "month" in bars.columns:
            bars = bars.where(keep_month(bound.strftime("%Y-%m")))
    if dedup:
        bars = dedup_bars(bars)
    bars = bars.select(*BAR_COLUMNS)
    return bars.orderBy("symbol", "timestamp") if ordered else bars


def dedup_bars(df: DataFrame) -> DataFrame:
    """Latest write per (symbol, interval, timestamp).

    An aggregate rather than a ranked window: copies of one key collapse on the map side,
    so a key with very many copies costs no more than any other.  The whole row is compared,
    so Spark sorts by key on both sides of the exchange; ties go to the greatest row.
    """
    rest = [c for c in df.columns if c not in (*KEY, "ingested_at")]
    newest = F.max(F.struct("ingested_at", *rest)).alias("_top")
    out = df.groupBy(*KEY).agg(newest)
    picked = {c: F.col("_top")[c].alias(c) for c in ("ingested_at", *rest)}
    return out.select(*[picked.get(c, F.col(c)) for c in df.columns])


def latest_timestamps(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "interval").agg(F.max("timestamp").alias("latest"))


def list_symbols(df: DataFrame, interval: str | None = None) -> DataFrame:
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    return df.select("symbol").distinct().orderBy("symbol")


def load_bars(
    bars: DataFrame,
    symbols: Sequence[str] | None,
    interval: str,
    start: datetime | None = None,
    end: datetime | None = None,
    resample_from: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Stored bars of ``interval``, or bars derived from the finer ``resample_from``."""
    if resample_from is None or resample_from == interval:
        return read_bars(bars, symbols, interval, start, end, ordered=ordered)
    base = read_bars(bars, symbols, resample_from, start, end, ordered=False)
    out = resample(base, interval, resample_from)
    return out.orderBy("symbol", "timestamp") if ordered else out


def write_artifacts(equity: DataFrame, path: str) -> None:
    """Equity frames of runs, one partition per ``spec_key``."""
    out = equity.hint("rebalance", "spec_key")
    out.write.mode("overwrite").partitionBy("spec_key").parquet(path)
