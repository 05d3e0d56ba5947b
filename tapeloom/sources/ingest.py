"""Landed vendor tables to bars, and the incremental load."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.expr import EPOCH, as_col, utc_midnight
from tapeloom.schema import BAR_COLUMNS, minutes_of

# Column names of the daily vendor layout.
VENDOR_COLUMNS = {
    "timestamp": "日期",
    "open": "开盘",
    "high": "最高",
    "low": "最低",
    "close": "收盘",
    "volume": "成交量",
}
PRICES = ("open", "high", "low", "close")


def bar_fault() -> Column:
    """Why a row is not a valid bar; NULL for a good one."""
    low, high = F.col("low"), F.col("high")
    absent = F.lit(False)
    for name in ("symbol", "timestamp", "volume"):
        absent = absent | F.col(name).isNull()
    for name in PRICES:
        absent = absent | F.col(name).isNull() | F.isnan(name)

    def outside(name: str) -> Column:
        return (F.col(name) < low) | (F.col(name) > high)

    return (
        F.when(absent, F.lit("missing value"))
        .when(F.col("volume") < 0, F.lit("negative volume"))
        .when(high < low, F.lit("high below low"))
        .when(outside("open"), F.lit("open outside range"))
        .when(outside("close"), F.lit("close outside range"))
    )


def tag_faults(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", bar_fault())


def validate_bars(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good bars, rejected bars with ``reason``)."""
    tagged = tag_faults(df)
    good = tagged.where(F.col("reason").isNull()).drop("reason")
    return good, tagged.where(F.col("reason").isNotNull())


def skip_report(bad: DataFrame) -> DataFrame:
    return bad.groupBy("symbol").agg(F.count(F.lit(1)).alias("skipped"))


def _shares(volume: Column | str, per_lot: int) -> Column:
    """Rounded to the even neighbour on a tie; NULL when the text is no finite number."""
    value = as_col(volume).try_cast("double") * per_lot
    return F.when(~F.isnan(value), F.bround(value, 0).try_cast("bigint"))


def parse_daily(raw: DataFrame, shares_per_lot: int = 100) -> DataFrame:
    """Daily vendor rows as bars with ``reason``; the calendar date becomes UTC midnight."""
    src = {name: F.col(f"`{column}`") for name, column in VENDOR_COLUMNS.items()}
    day = F.substring(src["timestamp"].cast("string"), 1, 10)
    stamp = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day.try_cast("date"))
    return tag_faults(
        raw.select(
            "symbol",
            F.lit("1d").alias("interval"),
            utc_midnight(stamp).alias("timestamp"),
            *[src[p].try_cast("double").alias(p) for p in PRICES],
            _shares(src["volume"], shares_per_lot).alias("volume"),
        )
    )


def parse_epoch(raw: DataFrame, interval: str, shares_per_lot: int = 1) -> DataFrame:
    """Second vendor layout: daily ``label`` YYYYMMDD, else ``time`` in epoch milliseconds."""
    if minutes_of(interval) == minutes_of("1d"):
        text = F.substring(F.col("label").cast("string"), 1, 8)
        parts = [F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)]
        day = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", *parts).try_cast("date"))
        stamp = utc_midnight(day)
    else:
        seconds = (F.col("time").try_cast("bigint") / 1000).cast("decimal(18,6)")
        zero = F.lit(0)
        stamp = F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, seconds)
    return tag_faults(
        raw.select(
            "symbol",
            F.lit(interval).alias("interval"),
            stamp.alias("timestamp"),
            *[F.col(p).try_cast("double").alias(p) for p in PRICES],
            _shares("volume", shares_per_lot).alias("volume"),
        )
    )


def _good(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("reason").isNull()).select(*BAR_COLUMNS)


def normalize_daily(raw: DataFrame, shares_per_lot: int = 100) -> DataFrame:
    """Valid bars of the daily vendor layout (rejects: ``parse_daily`` then ``skip_report``)."""
    return _good(parse_daily(raw, shares_per_lot))


def normalize_epoch(raw: DataFrame, interval: str, shares_per_lot: int = 1) -> DataFrame:
    return _good(parse_epoch(raw, interval, shares_per_lot))


def normalize_universe(raw: DataFrame) -> DataFrame:
    """(symbol, name) from either pair of column names; rows without a code are dropped."""

    def pick(*names: str) -> Column:
        present = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in raw.columns]
        return F.trim(F.coalesce(*present, F.lit("")))

    out = raw.select(pick("code", "代码").alias("symbol"), pick("name", "名称").alias("name"))
    return out.where(F.col("symbol") != "")


def sync_plan(
    universe: DataFrame,
    latest: DataFrame,
    start: datetime,
    lookback_days: int = 5,
    force: bool = False,
) -> DataFrame:
    """(symbol, latest, start): from where each symbol has to be fetched again."""
    origin = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    known = latest.select("symbol", "latest")
    if force:
        known = known.where(F.lit(False))
    resume = F.col("latest") - F.make_dt_interval(F.lit(lookback_days))
    joined = universe.select("symbol").join(known, "symbol", "left")
    return joined.withColumn("start", F.coalesce(resume, origin))


def incremental_upsert(incoming: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows to append: symbols that bring something newer, from their plan start on.

    The newest row per symbol is an aggregate joined back (small side), so no symbol's
    batch has to fit one task.
    """
    news = incoming.groupBy("symbol").agg(F.max("timestamp").alias("_newest"))
    due = (
        plan.join(news, "symbol")
        .where(F.col("latest").isNull() | (F.col("_newest") > F.col("latest")))
        .select("symbol", F.col("start").alias("_start"))
    )
    rows = incoming.join(due, "symbol").where(F.col("timestamp") >= F.col("_start"))
    return rows.select(*incoming.columns)


def backfill_status(universe: DataFrame, written: DataFrame, errors: DataFrame) -> DataFrame:
    """(symbol, status, rows, error) for every symbol asked for."""
    rows = written.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    failed = errors.groupBy("symbol").agg(F.max("error").alias("error"))
    out = universe.select("symbol").join(rows, "symbol", "left").join(failed, "symbol", "left")
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("rows", F.lit(0)) > 0, "synced")
        .otherwise("skipped")
    )
    landed = F.when(status == "synced", F.col("rows")).otherwise(F.lit(0))
    return out.select("symbol", status.alias("status"), landed.alias("rows"), "error")


def backfill_report(universe: DataFrame, written: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: total, synced, skipped, failed, rows."""
    status = backfill_status(universe, written, errors)
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("status") == s).alias(s) for s in ("synced", "skipped", "failed")
        ],
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )
