"""Market rules as columns and joins: limits, suspension, lots, stops, T+1."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.codes import DEFAULT_BAND, limit_pct
from tapeloom.functions.expr import as_col, ieee_div
from tapeloom.operators.series import DAILY, Series, lay_out, running

# Fixed value: shares of a board lot.
LOT = 100


@dataclass(frozen=True)
class MarketRules:
    t_plus_1: bool = True
    price_limits: bool = True
    suspension: bool = True
    participation_rate: float = 0.10
    default_limit: float = DEFAULT_BAND


@dataclass(frozen=True)
class RiskLimits:
    # Default risk caps, as fractions of equity unless a count.
    position: float = 0.20
    gross: float = 0.95
    daily_loss: float = 0.05
    stop: float = 0.08
    orders: int = 200


def suspension_flag(volume: Column | str = "volume") -> Column:
    return as_col(volume) <= 0


def whole_lots(shares: Column, lot: int = LOT) -> Column:
    return (F.floor(shares / lot) * lot).cast("bigint")


def volume_cap(volume: Column | str, rate: float = 0.10, lot: int = LOT) -> Column:
    """Most shares one order may take of a bar; NULL when the rate switches the cap off."""
    if rate <= 0:
        return F.lit(None).cast("bigint")
    return whole_lots(F.floor(as_col(volume) * rate), lot)


def participation(shares: Column | str, volume: Column | str) -> Column:
    return F.when(as_col(volume) > 0, as_col(shares) / as_col(volume)).otherwise(F.lit(0.0))


def target_shares(
    weight: Column | str, equity: Column | str, price: Column | str, lot: int = LOT
) -> Column:
    """Nearest whole lots for ``weight`` of ``equity``."""
    w, p = as_col(weight), as_col(price)
    lots = F.floor(ieee_div(w * as_col(equity), p) / lot + 0.5)
    return F.when((p > 0) & (w > 0), lots * lot).otherwise(F.lit(0)).cast("bigint")


def previous_day_close(df: DataFrame) -> DataFrame:
    """``df`` plus ``prev_close``, the last close of the symbol's trading day before.

    Closes are aggregated per date first, so bars of any interval get the day before.
    """
    day = F.to_date("timestamp")
    closes = df.groupBy("symbol", day.alias("_day")).agg(F.max_by("close", "timestamp").alias("_c"))
    before = F.lag("_c").over(Window.partitionBy("symbol").orderBy("_day"))  # one row per date
    closes = closes.select("symbol", "_day", before.alias("prev_close"))
    return df.withColumn("_day", day).join(closes, ["symbol", "_day"]).drop("_day")


def limit_band(
    df: DataFrame,
    rules: MarketRules = MarketRules(),
    price: str = "open",
) -> DataFrame:
    """Adds ``prev_close up_limit down_limit buy_blocked sell_blocked``; no band on day one."""
    pct, ref = limit_pct("symbol", rules.default_limit), F.col("prev_close")
    out = previous_day_close(df).withColumns(
        {"up_limit": F.round(ref * (1 + pct), 2), "down_limit": F.round(ref * (1 - pct), 2)}
    )
    no = F.lit(False)
    locked_up = F.coalesce(F.col(price) >= F.col("up_limit"), no) if rules.price_limits else no
    locked_down = F.coalesce(F.col(price) <= F.col("down_limit"), no) if rules.price_limits else no
    halted = suspension_flag() if rules.suspension else no
    return out.withColumns({"buy_blocked": halted | locked_up, "sell_blocked": halted | locked_down})


# --- stops -------------------------------------------------------------------


def stop_level(avg_price: Column | str, stop: float = 0.08) -> Column:
    return as_col(avg_price) * (1 - stop)


def stop_hit(holdings: DataFrame, df: DataFrame, stop: float = 0.08) -> DataFrame:
    """(holding, bar) pairs of the given bars that breach the stop, with the fill price.

    ``df`` is a cross-section of bars (one per symbol), so the join adds no rows.
    """
    level = stop_level("avg_price", stop)
    joined = holdings.join(df.select("symbol", "timestamp", "open", "low"), "symbol")
    joined = joined.withColumn("stop_price", level)
    joined = joined.withColumn("hit", F.col("low") <= F.col("stop_price"))
    fill = F.when(F.col("hit"), F.least("open", "stop_price"))
    return joined.withColumn("fill_price", fill)


def stop_exit_scan(
    entries: DataFrame, df: DataFrame, stop: float = 0.08, span: str = "month"
) -> DataFrame:
    """For each entry (symbol, entry_ts, entry_price, ...) the first later bar at or below its stop.

    Bars are folded into spans (a month holds at most 31 daily bars) and every symbol
    keeps the list of its span lows.  An entry looks for the breach in the rest of its own
    span, else finds the first later span with a low enough low and looks there.  Three
    equi-joins against one row per key replace the range join; an entry is never paired
    with the bars of its symbol.  For minute bars pass ``span="day"``.
    """
    key = F.date_trunc(span, "timestamp").cast("timestamp_ntz")
    spans = (
        df.withColumn("_span", key)
        .groupBy("symbol", "_span")
        .agg(
            F.sort_array(F.collect_list(F.struct("timestamp", "open", "low"))).alias("_bars"),
            F.min("low").alias("_low"),
        )
    )
    lows = spans.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("_span", "_low"))).alias("_lows")
    )
    level, entered = F.col("stop_price"), F.col("entry_ts")
    work = (
        entries.withColumn("stop_price", stop_level("entry_price", stop))
        .withColumn("_span", F.date_trunc(span, "entry_ts").cast("timestamp_ntz"))
        .join(spans.select("symbol", "_span", F.col("_bars").alias("_own")), ["symbol", "_span"], "left")
        .withColumn(
            "_hit",
            F.get(F.filter("_own", lambda b: (b["timestamp"] > entered) & (b["low"] <= level)), F.lit(0)),
        )
        .drop("_own")
        .join(lows, "symbol", "left")
    )
    later = F.filter("_lows", lambda s: (s["_span"] > F.col("_span")) & (s["_low"] <= level))
    work = work.withColumn(
        "_at", F.when(F.col("_hit").isNull(), F.get(later, F.lit(0))["_span"])
    ).drop("_lows", "_span")
    work = work.join(spans.select("symbol", F.col("_span").alias("_at"), "_bars"), ["symbol", "_at"], "left")
    there = F.get(F.filter("_bars", lambda b: b["low"] <= level), F.lit(0))
    bar = F.coalesce(F.col("_hit"), there)
    return work.select(
        *entries.columns,
        "stop_price",
        bar["timestamp"].alias("exit_ts"),
        F.when(bar.isNotNull(), F.least(bar["open"], level)).alias("exit_price"),
    )


def t1_sellable(
    holdings: DataFrame, fills: DataFrame, df: DataFrame, rules: MarketRules = MarketRules()
) -> DataFrame:
    """Holdings at the bars of ``df`` plus ``bought_today`` and ``sellable``."""
    bought = fills.where(F.col("side") == "buy")
    bought = bought.groupBy("account", "symbol", F.to_date("timestamp").alias("date")).agg(
        F.sum("shares").alias("_b")
    )
    bars = df.select("symbol", "timestamp", "volume", F.to_date("timestamp").alias("date"))
    out = holdings.join(bars, "symbol").join(bought, ["account", "symbol", "date"], "left")
    today = F.coalesce("_b", F.lit(0)).cast("bigint")
    free = F.greatest(F.col("shares") - today, F.lit(0)) if rules.t_plus_1 else F.col("shares")
    sellable = F.least(free, volume_cap("volume", rules.participation_rate))
    return out.select(
        *holdings.columns,
        "timestamp",
        "volume",
        today.alias("bought_today"),
        sellable.cast("bigint").alias("sellable"),
    )


def daily_loss_halt(
    equity: DataFrame,
    max_daily_loss: float = 0.05,
    series: Series = Series(("account", "_day"), step=None),
) -> DataFrame:
    """Per (account, timestamp): day-start equity and whether trading is halted, latched.

    The day starts with the last equity of the day before (its own first value on day one);
    that is a table of one row per account and date.  The latch is a running maximum inside
    the day.
    """
    tagged = equity.withColumn("_day", F.to_date("timestamp"))
    days = tagged.groupBy("account", "_day").agg(
        F.min_by("equity", "timestamp").alias("_open"),
        F.max_by("equity", "timestamp").alias("_close"),
    )
    before = F.lag("_close").over(Window.partitionBy("account").orderBy("_day"))
    starts = days.select("account", "_day", F.coalesce(before, F.col("_open")).alias("day_start"))
    judged = tagged.join(starts, ["account", "_day"])
    breach = F.col("equity") <= F.col("day_start") * (1 - max_daily_loss)
    lay = running(lay_out(judged, series), {"halted": ("max", breach)})
    return lay.df.select(*equity.columns, "day_start", "halted")
