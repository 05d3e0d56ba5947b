"""Portfolio weights and the rebalance calendar."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.expr import ieee_div
from tapeloom.operators.selection import YEAR, Score, join_fundamentals, select_top_n
from tapeloom.operators.series import DAILY, Series, lay_out, running
from tapeloom.session import settle

# Default gross budget and per-name cap.
GROSS, NAME_CAP = 0.95, 0.20


def _scaled(
    picks: DataFrame, raw: Column, gross: float, max_weight: float, by: Sequence[str]
) -> DataFrame:
    """Positive raw sizes scaled to ``gross``, then capped; totals are an aggregate joined back."""
    sized = picks.withColumn("_raw", raw.cast("double")).where(F.col("_raw") > 0)
    totals = sized.groupBy(*by).agg(F.sum("_raw").alias("_total"))
    share = F.col("_raw") / F.col("_total") * gross
    out = sized.join(totals, list(by)).withColumn("weight", F.least(share, F.lit(max_weight)))
    return out.select(*by, "symbol", "weight")


def equal_weight(
    picks: DataFrame,
    gross: float = GROSS,
    max_weight: float = NAME_CAP,
    by: Sequence[str] = ("asof",),
) -> DataFrame:
    return _scaled(picks, F.lit(1.0), gross, max_weight, by)


def inverse_vol(
    picks: DataFrame,
    vol_col: str = "volatility",
    gross: float = GROSS,
    max_weight: float = NAME_CAP,
    by: Sequence[str] = ("asof",),
) -> DataFrame:
    raw = F.when(F.col(vol_col) > 0, ieee_div(F.lit(1.0), vol_col))
    return _scaled(picks, raw, gross, max_weight, by)


def score_proportional(
    picks: DataFrame,
    score_col: str = "score",
    gross: float = GROSS,
    max_weight: float = NAME_CAP,
    by: Sequence[str] = ("asof",),
) -> DataFrame:
    return _scaled(picks, F.col(score_col), gross, max_weight, by)


# --- calendar: every window here runs over distinct dates only ----------------


def trading_calendar(df: DataFrame) -> DataFrame:
    """Distinct UTC dates with any bar."""
    return df.select(F.to_date("timestamp").alias("date")).distinct()


def _calendar_window() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("date")


def rebalance_dates(calendar: DataFrame, lookback: int = 60, every: int = 21) -> DataFrame:
    """Every ``every``-th date once ``lookback`` dates have passed."""
    place = F.row_number().over(_calendar_window()) - 1
    numbered = calendar.withColumn("_place", place)
    due = (F.col("_place") >= lookback) & ((F.col("_place") - lookback) % every == 0)
    return numbered.where(due).select(F.col("date").alias("asof"))


def effective_dates(days: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, effective): the latest of ``dates`` (column ``asof``) not after each date."""
    both = days.select("date", F.lit(None).cast("date").alias("_set")).unionByName(
        dates.select(F.col("asof").alias("date"), F.col("asof").alias("_set"))
    )
    both = both.groupBy("date").agg(F.max("_set").alias("_set"), F.count_if(F.col("_set").isNull()).alias("_n"))
    upto = _calendar_window().rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("effective", F.last("_set", ignorenulls=True).over(upto))
    return both.where(F.col("_n") > 0).select("date", "effective")


def _next_dates(days: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, asof): the first of ``dates`` strictly after each date."""
    both = days.select("date", F.lit(None).cast("date").alias("_set")).unionByName(
        dates.select(F.col("asof").alias("date"), F.col("asof").alias("_set"))
    )
    both = both.groupBy("date").agg(F.max("_set").alias("_set"), F.count_if(F.col("_set").isNull()).alias("_n"))
    after = _calendar_window().rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("asof", F.first("_set", ignorenulls=True).over(after))
    return both.where((F.col("_n") > 0) & F.col("asof").isNotNull()).select("date", "asof")


def features_asof(
    df: DataFrame,
    dates: DataFrame,
    lookback: int = 60,
    series: Series = DAILY,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """The cross-section of ``build_features`` at every date of ``dates`` in one pass.

    ``calendar`` is the trading calendar of ``df`` when it is already at hand.

    Rolling frames give the features of every bar; the newest bar before each date is an
    aggregate per (symbol, next date); dates without new bars repeat the row before.
    """
    lay = lay_out(df, series, lookback)
    lay = lay.with_levels([{"_ret": ieee_div("close", lay.lag("close")) - 1}])
    full, inner = lay.tail(lookback), lay.tail(lookback - 1)
    lay = lay.with_levels(
        [
            {
                "price": F.col("close"),
                "adv": F.avg(F.col("close") * F.col("volume")).over(full),
                "volatility": F.stddev_samp("_ret").over(inner) * math.sqrt(YEAR),
                "momentum": ieee_div("close", F.first("close").over(full)) - 1,
                "bars": F.count(F.lit(1)).over(full),
            }
        ]
    ).own()
    names = ("price", "adv", "volatility", "momentum", "bars")
    bars = lay.df.select("symbol", "timestamp", F.to_date("timestamp").alias("date"), *names)
    upcoming = _next_dates(calendar or trading_calendar(df), dates)
    newest = (
        bars.join(upcoming, "date")
        .groupBy("symbol", "asof")
        .agg(*[F.max_by(n, "timestamp").alias(n) for n in names])
    )
    # At most one row per symbol and rebalance date from here on.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("asof"))
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    numbered = dates.withColumns({"_k": place, "_end": total})
    until = F.coalesce(
        F.lead("_k").over(Window.partitionBy("symbol").orderBy("_k")) - 1, F.col("_end")
    )
    return (
        newest.join(numbered, "asof")
        .withColumn("_until", until)
        .withColumn("_k", F.explode(F.sequence("_k", "_until")))
        .drop("asof", "_end", "_until")
        .join(numbered.drop("_end"), "_k")
        .select("asof", "symbol", *names)
    )


Allocator = Callable[[DataFrame], DataFrame]


def periodic_schedule(
    df: DataFrame,
    filters: Sequence[Column] = (),
    score: Score | None = None,
    top_n: int | None = None,
    allocator: Allocator = equal_weight,
    every: int = 21,
    lookback: int = 60,
    fundamentals: DataFrame | None = None,
    series: Series = DAILY,
) -> tuple[DataFrame, DataFrame]:
    """(all rebalance dates, weights per date and symbol); a date without weights is flat."""
    calendar = settle(trading_calendar(df))  # one row per date, read several times
    dates = rebalance_dates(calendar, lookback, every)
    # One row per date and symbol; kept, because ranking and allocation read it again.
    features = settle(features_asof(df, dates, lookback, series, calendar))
    if fundamentals is not None:
        features = join_fundamentals(features, fundamentals)
    return dates, allocator(select_top_n(features, filters, score, top_n))


def union_universe(weights: DataFrame) -> DataFrame:
    return weights.select("symbol").distinct().orderBy("symbol")


def active_budget(signals: DataFrame, dates: DataFrame, weights: DataFrame) -> DataFrame:
    """``signals`` plus ``budget``: the weight of the schedule in force on the bar's date.

    The as-of step runs on distinct dates only; bars then take two equi-joins.
    """
    force = effective_dates(trading_calendar(signals), dates)
    book = weights.select(F.col("asof").alias("_eff"), "symbol", F.col("weight").alias("_w"))
    return (
        signals.withColumn("date", F.to_date("timestamp"))
        .join(force.withColumnRenamed("effective", "_eff"), "date", "left")
        .join(book, ["_eff", "symbol"], "left")
        .withColumn("budget", F.coalesce("_w", F.lit(0.0)))
        .select(*signals.columns, "budget")
    )


def static_budget(signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Budget without a schedule: fixed weights, 1.0 for symbols without one."""
    if weights is None:
        return signals.withColumn("budget", F.lit(1.0))
    book = weights.select("symbol", F.col("weight").alias("_w"))
    out = signals.join(book, "symbol", "left")
    return out.select(*signals.columns, F.coalesce("_w", F.lit(1.0)).alias("budget"))


def budgeted_weight(signal: Column | str, budget: Column | str, cap: float = NAME_CAP) -> Column:
    s = F.col(signal) if isinstance(signal, str) else signal
    b = F.col(budget) if isinstance(budget, str) else budget
    return F.least(F.greatest(s * b, F.lit(0.0)), F.lit(cap))


def portfolio_equity(budgeted: DataFrame, series: Series = DAILY) -> DataFrame:
    """(timestamp, ret, equity): budget-weighted return less cost per bar time, compounded."""
    per_bar = (
        budgeted.groupBy("timestamp")
        .agg(F.sum(F.col("budget") * F.col("ret")).alias("ret"))
        .withColumn("_book", F.lit(0))
    )
    lay = lay_out(per_bar, series.by(("_book",)))
    lay = running(lay, {"equity": ("product", 1 + F.col("ret"))})
    return lay.df.select("timestamp", "ret", "equity")
