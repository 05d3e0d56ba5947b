"""Cash and position ledgers, marking and the equity curve, from a table of fills.

Fills have (account, timestamp, seq, symbol, side, shares, price[, cost, reason]); ``seq``
orders fills of equal time.  Ledgers run over accounts of any size in blocks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.costs import CostModel
from tapeloom.operators.series import Series, blended, lay_out, running

ORDER = ("timestamp", "seq")
ACCOUNT = Series(("account",), ORDER, None)
POSITION = Series(("account", "symbol"), ORDER, None)


def _is_sell() -> Column:
    return F.col("side") == "sell"


def _signed(amount: Column) -> Column:
    return F.when(_is_sell(), -amount).otherwise(amount)


def fills_enriched(fills: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Adds ``notional`` and, where absent, ``cost`` (no impact without ``participation``)."""
    out = fills.withColumn("notional", F.col("shares") * F.col("price"))
    if "cost" in fills.columns:
        return out
    share = F.col("participation") if "participation" in fills.columns else F.lit(0.0)
    return out.withColumn("cost", costs.trade_cost(F.col("notional"), _is_sell(), share))


def cash_ledger(enriched: DataFrame, start_cash: float, series: Series = ACCOUNT) -> DataFrame:
    """Fills plus running ``cash`` of the account."""
    flow = -_signed(F.col("notional")) - F.col("cost")
    lay = running(lay_out(enriched, series), {"_flow": ("sum", flow)})
    return lay.df.select(*enriched.columns, (F.lit(float(start_cash)) + F.col("_flow")).alias("cash"))


def position_ledger(fills: DataFrame, series: Series = POSITION) -> DataFrame:
    """Fills plus running ``held`` and ``avg_price``: buys blend, sells keep, flat resets.

    With w = bought / held after, the average is e = (1 - w) e + w price on a buy and
    unchanged on a sell: a linear recursion that runs blockwise.
    """
    lay = running(lay_out(fills, series), {"held": ("sum", _signed(F.col("shares")))})
    fresh = ~_is_sell() & (F.col("held") <= F.col("shares"))
    weight = (
        F.when(_is_sell(), F.lit(0.0)).when(fresh, F.lit(1.0)).otherwise(F.col("shares") / F.col("held"))
    )
    lay = blended(lay, "_avg", weight, F.col("price"))
    avg = F.when(F.col("held") > 0, F.col("_avg"))
    return lay.df.select(*fills.columns, F.col("held").cast("bigint").alias("held"), avg.alias("avg_price"))


def holdings_of(ledger: DataFrame) -> DataFrame:
    """Open positions after the last fill: (account, symbol, shares, avg_price)."""
    last = ledger.groupBy("account", "symbol").agg(
        F.max_by(F.struct("held", "avg_price"), F.struct(*ORDER)).alias("_p")
    )
    out = last.select("account", "symbol", F.col("_p.held").alias("shares"), F.col("_p.avg_price").alias("avg_price"))
    return out.where(F.col("shares") > 0)


# --- marking -----------------------------------------------------------------


def clock_of(df: DataFrame) -> DataFrame:
    """(timestamp, tick): the distinct bar times, numbered.

    Days are numbered by a window over the calendar; ticks inside a day by a window per day.
    """
    ticks = df.select("timestamp").distinct().withColumn("_day", F.to_date("timestamp"))
    per_day = ticks.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("timestamp"))
    return (
        ticks.join(per_day, "_day")
        .withColumn("tick", F.col("_before") + inside)
        .select("timestamp", "tick")
    )


def _tick_at(states: DataFrame, clock: DataFrame) -> DataFrame:
    """``states`` plus ``tick``, the first tick at or after their time; NULL after the last one.

    The dates from the first to the last bar come from the clock alone, so the states are
    read once.
    """
    days = clock.groupBy(F.to_date("timestamp").alias("_day")).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "tick"))).alias("_ticks"),
        F.min("tick").alias("_first"),
    )
    bounds = clock.agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b"))
    dates = bounds.select(F.explode(F.sequence("a", "b")).alias("_day"))
    after = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    calendar = dates.join(days, "_day", "left").withColumn("_next", F.min("_first").over(after)).drop("_first")
    opening = clock.agg(F.min(F.to_date("timestamp"))).scalar()
    in_day = F.filter("_ticks", lambda t: t["timestamp"] >= F.col("timestamp"))
    return (
        states.withColumn("_day", F.greatest(F.to_date("timestamp"), opening))
        .join(calendar, "_day", "left")
        .withColumn("tick", F.coalesce(F.get(in_day, F.lit(0))["tick"], F.col("_next")))
        .drop("_day", "_ticks", "_next")
    )


def _spread(states: DataFrame, keys: tuple[str, ...], clock: DataFrame) -> DataFrame:
    """Repeat the state of each key at every tick until its next state.

    ``states`` has at most one row per key and tick, so the window is bounded by the clock.
    """
    end = clock.agg(F.max("tick")).scalar()
    until = F.lead("tick").over(Window.partitionBy(*keys).orderBy("tick")) - 1
    return (
        states.withColumn("_until", F.least(F.coalesce(until, end), end))
        .where(F.col("tick") <= F.col("_until"))
        .withColumn("tick", F.explode(F.sequence("tick", "_until")))
        .drop("_until")
    )


def _last_per_tick(rows: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    return (
        rows.groupBy(*keys, "tick")
        .agg(F.max_by(F.struct(*values), F.struct(*ORDER)).alias("_v"))
        .select(*keys, "tick", "_v.*")
    )


def mark_to_market(ledger: DataFrame, df: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Open positions at every bar time: price, market value and unrealised P&L.

    The price is the last known close of the symbol, else the entry price.  ``clock`` is
    ``clock_of(df)`` when it is already at hand.
    """
    clock = clock_of(df) if clock is None else clock
    keys = ("account", "symbol")
    ticked = _tick_at(ledger, clock).where(F.col("tick").isNotNull())
    states = _last_per_tick(ticked, keys, ("held", "avg_price"))
    open_ = _spread(states, keys, clock).where(F.col("held") > 0)
    closes = df.select("symbol", "timestamp", "close").join(clock, "timestamp")
    prices = _spread(closes.select("symbol", "tick", "close"), ("symbol",), clock)
    price = F.coalesce("close", "avg_price")
    return (
        open_.join(prices, ["symbol", "tick"], "left")
        .join(clock, "tick")
        .select(
            "account",
            "timestamp",
            "symbol",
            F.col("held").alias("shares"),
            "avg_price",
            price.alias("price"),
            (F.col("held") * price).alias("market_value"),
            (F.col("held") * (price - F.col("avg_price"))).alias("unrealized_pnl"),
        )
    )


def equity_curve(
    cash: DataFrame,
    marks: DataFrame,
    df: DataFrame,
    start_cash: float,
    clock: DataFrame | None = None,
) -> DataFrame:
    """(account, timestamp, cash, market_value, equity) at every bar time."""
    clock = clock_of(df) if clock is None else clock
    end = clock.agg(F.max("tick")).scalar()
    ticked = _tick_at(cash, clock).withColumn("tick", F.coalesce("tick", end + 1))
    states = _last_per_tick(ticked, ("account",), ("cash",))
    # The first state of an account comes with the opening balance before it.
    earlier = F.lag("tick").over(Window.partitionBy("account").orderBy("tick"))
    opening = F.struct(F.lit(1).cast("bigint").alias("tick"), F.lit(float(start_cash)).alias("cash"))
    own = F.struct("tick", "cash")
    both = F.when(earlier.isNull() & (F.col("tick") > 1), F.array(opening, own)).otherwise(F.array(own))
    known = states.withColumn("_both", both).select("account", F.explode("_both").alias("_s")).select("account", "_s.*")
    balances = _spread(known, ("account",), clock).join(clock, "tick")
    value = marks.groupBy("account", "timestamp").agg(F.sum("market_value").alias("_mv"))
    worth = F.coalesce("_mv", F.lit(0.0))
    return balances.join(value, ["account", "timestamp"], "left").select(
        "account",
        "timestamp",
        "cash",
        worth.alias("market_value"),
        (F.col("cash") + worth).alias("equity"),
    )
