"""Order sizing, the dry-run order sheet and order checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.expr import ieee_div
from tapeloom.operators.allocation import budgeted_weight
from tapeloom.operators.backtest import Signal, with_target
from tapeloom.operators.market import (
    LOT,
    MarketRules,
    RiskLimits,
    stop_level,
    target_shares,
    volume_cap,
)
from tapeloom.operators.selection import newest_bars
from tapeloom.operators.series import DAILY, Series, lay_out, running


def buy_room(
    price: Column, equity: Column, cash: Column, held: Column, avg_price: Column, at_cost: Column,
    limits: RiskLimits, lot: int = LOT,
) -> Column:
    """Whole lots within the name, gross and cash budgets; other names count at cost."""
    zero = F.lit(0.0)
    name = F.greatest(limits.position * equity - held * price, zero)
    invested = at_cost - held * avg_price + held * price
    book = F.greatest(limits.gross * equity - invested, zero)
    budget = F.least(name, book, cash)
    lots = F.floor(ieee_div(budget, price * lot)) * lot
    return F.when(price > 0, F.greatest(lots, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def _with_book(candidates: DataFrame, holdings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Candidates (account, symbol, ..) plus held shares, entry price, book at cost, cash, equity."""
    cost = holdings.groupBy("account").agg(F.sum(F.col("shares") * F.col("avg_price")).alias("_cost"))
    book = accounts.join(cost, "account", "left").withColumn("_cost", F.coalesce("_cost", F.lit(0.0)))
    mine = holdings.select("account", "symbol", F.col("shares").alias("_h"), F.col("avg_price").alias("_a"))
    out = candidates.join(book, "account").join(mine, ["account", "symbol"], "left")
    return out.withColumns({"_h": F.coalesce("_h", F.lit(0)), "_a": F.coalesce("_a", F.lit(0.0))})


def max_buy_shares(
    candidates: DataFrame,
    holdings: DataFrame,
    accounts: DataFrame,
    limits: RiskLimits = RiskLimits(),
    lot: int = LOT,
) -> DataFrame:
    """``candidates`` (account, symbol, price) plus ``max_shares``.

    ``accounts`` has (account, cash, equity); each candidate is sized against the snapshot.
    """
    book = _with_book(candidates, holdings, accounts)
    names = ("price", "equity", "cash", "_h", "_a", "_cost")
    room = buy_room(*[F.col(c) for c in names], limits=limits, lot=lot)
    return book.select(*candidates.columns, room.alias("max_shares"))


def order_delta(
    bars: DataFrame,
    holdings: DataFrame,
    accounts: DataFrame,
    bought_today: DataFrame | None = None,
    rules: MarketRules = MarketRules(),
    limits: RiskLimits = RiskLimits(),
    lot: int = LOT,
) -> DataFrame:
    """Orders that move each account towards its target weights at the given bars.

    ``bars`` has one row per (account, symbol) with ``open volume signal budget`` and the
    blocks of ``limit_band``; ``accounts`` has (account, cash, equity[, halted]).  Every
    symbol is sized against the same snapshot.
    """
    if "halted" not in accounts.columns:
        accounts = accounts.withColumn("halted", F.lit(False))
    book = _with_book(bars, holdings, accounts)
    if bought_today is not None:
        today = bought_today.select("account", "symbol", F.col("shares").alias("_b"))
        book = book.join(today, ["account", "symbol"], "left")
    else:
        book = book.withColumn("_b", F.lit(0))
    price, held = F.col("open"), F.col("_h")
    weight = budgeted_weight("signal", "budget", limits.position)
    book = book.withColumn("desired", target_shares(weight, "equity", "open", lot))
    cap = volume_cap("volume", rules.participation_rate, lot)
    names = ("equity", "cash", "_h", "_a", "_cost")
    room = buy_room(price, *[F.col(c) for c in names], limits=limits, lot=lot)
    delta = F.col("desired") - held
    buy = F.when(F.col("halted") | F.col("buy_blocked"), F.lit(0)).otherwise(F.least(delta, room, cap))
    free = F.greatest(held - F.coalesce("_b", F.lit(0)), F.lit(0)) if rules.t_plus_1 else held
    sell = F.when(F.col("sell_blocked"), F.lit(0)).otherwise(F.least(-delta, free, cap))
    side = F.when(delta > 0, "buy").when(delta < 0, "sell")
    shares = F.when(delta > 0, buy).when(delta < 0, sell).otherwise(F.lit(0)).cast("bigint")
    out = book.select(
        "account", "symbol", "timestamp", "desired", held.cast("bigint").alias("held"),
        side.alias("side"), shares.alias("shares"), price.alias("price"),
    )
    return out.where(F.col("shares") > 0)


def order_cap(
    orders: DataFrame,
    cap: int = 200,
    order: tuple[str, ...] = ("timestamp", "seq"),
    series: Series | None = None,
) -> DataFrame:
    """``nth`` order of the account's day and ``allowed``; the cap blocks buys only.

    Counting runs in blocks, so a day of one account need not fit a task.
    """
    tagged = orders.withColumn("_day", F.to_date("timestamp"))
    if series is None:
        series = Series(("account", "_day"), order, None)
    lay = running(lay_out(tagged, series), {"nth": ("sum", F.lit(1))})
    allowed = (F.col("side") == "sell") | (F.col("nth") <= cap)
    return lay.df.select(*orders.columns, F.col("nth").cast("bigint").alias("nth"), allowed.alias("allowed"))


def lot_check(orders: DataFrame, lot: int = LOT) -> DataFrame:
    return orders.where((F.col("shares") > 0) & (F.col("shares") % lot == 0))


def latest_targets(
    df: DataFrame, signal: Signal, lookback: int = 250, interval: str | None = None
) -> DataFrame:
    """(symbol, timestamp, price, target) of each symbol's newest bar, from ``lookback`` bars.

    Only the newest rows leave the scan tasks; the signal then sees at most ``lookback``
    rows per symbol.  ``interval`` picks the bars where ``df`` holds several.
    """
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    recent = with_target(newest_bars(df, lookback), signal, DAILY)
    newest = recent.where(F.col("_age") == 1)
    return newest.select(
        "symbol",
        "timestamp",
        F.col("close").alias("price"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
    )


def order_sheet(
    df: DataFrame,
    signal: Signal,
    universe: DataFrame,
    holdings: DataFrame,
    accounts: DataFrame,
    limits: RiskLimits = RiskLimits(),
    lookback: int = 250,
    lot: int = LOT,
    interval: str | None = None,
) -> DataFrame:
    """Dry-run scan: (account, nth, symbol, side, shares, price, reason).

    ``universe`` has the (account, symbol) pairs to scan, ``accounts`` (account, cash,
    day_start_equity).  Stops watch every holding.  The account does not change during
    a dry run, so all orders follow from one snapshot: stops first, then entries and exits,
    by symbol.  Buys stop at a halt or past the order cap; every order counts for the cap.
    """
    quotes = latest_targets(df, signal, lookback, interval)
    held = holdings.select("account", "symbol", "shares", "avg_price")
    scanned = universe.select("account", "symbol").distinct().withColumn("_scanned", F.lit(True))
    book = scanned.join(held, ["account", "symbol"], "full").join(quotes, "symbol")
    marks = held.join(quotes.select("symbol", "price"), "symbol", "left")
    value = marks.groupBy("account").agg(
        F.sum(F.col("shares") * F.coalesce("price", "avg_price")).alias("_mv"),
        F.sum(F.col("shares") * F.col("avg_price")).alias("_cost"),
    )
    state = accounts.join(value, "account", "left").withColumns(
        {
            "equity": F.col("cash") + F.coalesce("_mv", F.lit(0.0)),
            "_cost": F.coalesce("_cost", F.lit(0.0)),
        }
    )
    halted = F.col("equity") <= F.col("day_start_equity") * (1 - limits.daily_loss)
    state = state.withColumn("_halted", F.coalesce(halted, F.lit(False)))
    book = book.join(state, "account").withColumns(
        {"_h": F.coalesce("shares", F.lit(0)), "_a": F.coalesce("avg_price", F.lit(0.0))}
    )
    price = F.col("price")
    stopped = (F.col("_h") > 0) & (price <= stop_level("_a", limits.stop))
    names = ("equity", "cash", "_h", "_a", "_cost")
    room = buy_room(price, *[F.col(c) for c in names], limits=limits, lot=lot)
    scan = F.coalesce("_scanned", F.lit(False))
    enter = scan & (F.col("target") > 0) & (F.col("_h") == 0) & ~F.col("_halted")
    leave = scan & (F.col("target") <= 0) & (F.col("_h") > 0)
    plan = book.withColumn(
        "reason",
        F.when(F.coalesce(stopped, F.lit(False)), "stop_loss").when(enter, "signal").when(leave, "signal_exit"),
    )
    plan = plan.where(F.col("reason").isNotNull()).withColumns(
        {
            "side": F.when(F.col("reason") == "signal", "buy").otherwise("sell"),
            "shares": F.when(F.col("reason") == "signal", room).otherwise(F.col("_h")).cast("bigint"),
            "_phase": F.when(F.col("reason") == "stop_loss", 0).otherwise(1),
        }
    )
    return _capped(plan.where(F.col("shares") > 0), limits.orders)


def _capped(plan: DataFrame, cap: int) -> DataFrame:
    """Number the submitted orders of each account; buys end at the cap, sells go on.

    A buy is submitted while fewer than ``cap`` orders were submitted before it.  Before the
    cap every order is submitted, so its place among all orders decides.
    """
    rows = Window.partitionBy("account").orderBy("_phase", "symbol")
    place = F.row_number().over(rows)
    kept = plan.withColumn("_place", place).where((F.col("side") == "sell") | (F.col("_place") <= cap))
    return kept.select(
        "account", F.row_number().over(rows).alias("nth"), "symbol", "side", "shares", "price", "reason"
    )
