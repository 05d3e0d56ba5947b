"""Tables behind the daily report, the telemetry log and the charts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.expr import EPOCH, ieee_div
from tapeloom.operators.series import DAILY, Series, lay_out, running


def daily_report(
    enriched: DataFrame, marks: DataFrame, equity: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, trades, positions) per account and date, as of the last bar of the date."""
    day = F.to_date("timestamp").alias("date")
    sell = F.col("side") == "sell"
    traded = enriched.groupBy("account", day).agg(
        F.count(F.lit(1)).alias("fills"),
        F.count_if(~sell).alias("buys"),
        F.count_if(sell).alias("sells"),
        F.sum("cost").alias("costs"),
    )
    closing = equity.groupBy("account", day).agg(
        *[F.max_by(c, "timestamp").alias(c) for c in ("equity", "cash", "market_value")],
        F.max("timestamp").alias("_at"),
    )
    last = closing.select("account", "date", F.col("_at").alias("timestamp"))
    positions = marks.join(last, ["account", "timestamp"]).select(
        "account", "date", "symbol", "shares", "avg_price", "price", "unrealized_pnl"
    )
    held = positions.groupBy("account", "date").agg(F.count(F.lit(1)).alias("open_positions"))
    counts = ("fills", "buys", "sells", "open_positions")
    summary = (
        closing.drop("_at")
        .join(traded, ["account", "date"], "left")
        .join(held, ["account", "date"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
        .withColumn("costs", F.coalesce("costs", F.lit(0.0)))
    )
    trades = enriched.select("account", day, "symbol", "side", "shares", "price", "cost", "reason")
    return summary, trades, positions


def epoch_ns(ts: str = "timestamp") -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col(ts)) * 1000


def telemetry_log(
    equity: DataFrame, marks: DataFrame, df: DataFrame, fills: DataFrame, series: Series = DAILY
) -> DataFrame:
    """One table over the topics equity, portfolio, bars and fills, stamped in epoch ns.

    A portfolio row nests the open positions of one account at one bar time (at most one
    entry per instrument).  Fills without a time are dropped.
    """
    lay = running(lay_out(equity, series.by(("account",))), {"_peak": ("max", F.col("equity"))})
    curve = lay.df.select(
        F.lit("equity").alias("topic"),
        epoch_ns().alias("log_time"),
        "account",
        "equity",
        "cash",
        (ieee_div("equity", "_peak") - 1).alias("drawdown"),
    )
    worth = F.col("equity")
    weight = F.when(worth != 0, F.col("market_value") / worth).otherwise(F.lit(0.0))
    nested = F.struct(
        "symbol", "shares", "avg_price", "price", "market_value", "unrealized_pnl", weight.alias("weight")
    )
    totals = equity.select("account", "timestamp", "equity", "cash")
    portfolio = (
        marks.join(totals, ["account", "timestamp"], "left")
        .groupBy("account", "timestamp")
        .agg(
            F.first("equity").alias("equity"),
            F.first("cash").alias("cash"),
            F.count(F.lit(1)).alias("num_positions"),
            F.sort_array(F.collect_list(nested)).alias("positions"),
        )
        .select(
            F.lit("portfolio").alias("topic"),
            epoch_ns().alias("log_time"),
            "account", "equity", "cash", "num_positions", "positions",
        )
    )
    bars = df.select(
        F.lit("bars").alias("topic"),
        epoch_ns().alias("log_time"),
        "symbol", "open", "high", "low", "close",
        F.col("volume").cast("double").alias("volume"),
    )
    trades = fills.where(F.col("timestamp").isNotNull()).select(
        F.lit("fills").alias("topic"),
        epoch_ns().alias("log_time"),
        "account", "symbol", "side", "shares", "price", "cost", "notional", "reason",
    )
    out = curve
    for part in (portfolio, bars, trades):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def chart_series(df: DataFrame, columns: Sequence[str], x: str = "timestamp", ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """Long form (ids, x, series, value) of the chosen columns."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*ids, x, *doubles).unpivot([*ids, x], list(columns), "series", "value")
