"""Signals, the costed weight-space backtest and its statistics."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.costs import CostModel
from tapeloom.functions.expr import ieee_div
from tapeloom.operators.indicators import rsi_recipe, with_averages, zip_levels
from tapeloom.operators.series import DAILY, Layout, Series, lay_out, running
from tapeloom.operators.summary import summary_by_symbol


@dataclass(frozen=True)
class Draft:
    """Levels of window columns and the column with the raw target."""

    raw: Column
    levels: list[dict[str, Column]] = field(default_factory=list)


@dataclass(frozen=True)
class Signal:
    """Target weight per bar.  ``latch`` keeps the last non-NULL target (0 before the first).

    ``rsi`` is a (column, window) whose RSI ``cook`` finds in ``{prefix}_rsi``.
    """

    name: str
    lookback: int
    cook: Callable[[Layout, str], Draft]
    latch: bool = False
    rsi: tuple[str, int] | None = None


def buy_and_hold() -> Signal:
    return Signal("buy_and_hold", 0, lambda lay, p: Draft(F.lit(1.0)))


def sma_cross(fast: int = 10, slow: int = 30, column: str = "close") -> Signal:
    def cook(lay: Layout, p: str) -> Draft:
        quick, steady = lay.rolling(F.avg, column, fast), lay.rolling(F.avg, column, slow)
        levels = [{f"{p}_q": quick, f"{p}_s": steady}]
        return Draft(F.when(F.col(f"{p}_q") > F.col(f"{p}_s"), 1.0).otherwise(0.0), levels)

    return Signal(f"sma_cross_{fast}_{slow}", max(fast, slow) - 1, cook)


def rsi_reversion(
    window: int = 14, low: float = 30.0, high: float = 70.0, column: str = "close"
) -> Signal:
    def cook(lay: Layout, p: str) -> Draft:
        level = F.col(f"{p}_rsi")
        raw = F.when(level < low, 1.0).when(level > high, 0.0)
        return Draft(raw)

    return Signal(f"rsi_reversion_{window}", 0, cook, latch=True, rsi=(column, window))


def scaled_rsi(
    window: int = 14, low: float = 30.0, high: float = 70.0, column: str = "close"
) -> Signal:
    def cook(lay: Layout, p: str) -> Draft:
        ramp = (high - F.col(f"{p}_rsi")) / (high - low)
        ramp = F.when(F.isnan(ramp), F.lit(0.0)).otherwise(
            F.least(F.greatest(ramp, F.lit(0.0)), F.lit(1.0))
        )
        return Draft(F.when(F.col(f"{p}_rsi").isNull(), F.lit(0.0)).otherwise(ramp))

    return Signal(f"scaled_rsi_{window}", 0, cook, rsi=(column, window))


SIGNALS: dict[str, Callable[..., Signal]] = {
    "buy_and_hold": buy_and_hold,
    "sma_cross": sma_cross,
    "rsi_reversion": rsi_reversion,
    "scaled_rsi": scaled_rsi,
}


def build_signal(name: str, params: Mapping[str, object] | None = None) -> Signal:
    if name not in SIGNALS:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(SIGNALS)}")
    return SIGNALS[name](**dict(params or {}))


def _with_rsi(df: DataFrame, signals: Sequence[Signal], series: Series) -> DataFrame:
    """The averages that signals look back on, before rows are laid out for looking back."""
    wanted = {f"_sig{k}": signal.rsi for k, signal in enumerate(signals) if signal.rsi}
    if not wanted:
        return df
    lay = lay_out(df, series, 1)
    recipes = [rsi_recipe(lay, p, column, window) for p, (column, window) in wanted.items()]
    lay = with_averages(lay.with_levels(zip_levels(*[r.levels for r in recipes])), recipes)
    return lay.df.select(*df.columns, *[f"{p}_rsi" for p in wanted])


def _laid_out(df: DataFrame, signals: Sequence[Signal], series: Series, more: int) -> Layout:
    return lay_out(_with_rsi(df, signals, series), series, max(s.lookback for s in signals) + more)


def _targets(lay: Layout, signals: Sequence[Signal], ages: int) -> Layout:
    """Columns ``_s0t0 _s0t1 ..`` = target of signal 0 now, one bar ago, ..; drops halo rows.

    The levels of all signals are merged, so any number of signals shares one sort.
    """
    drafts = [signal.cook(lay, f"_sig{k}") for k, signal in enumerate(signals)]
    lay = lay.with_levels(zip_levels(*[d.levels for d in drafts]))
    lay = lay.with_levels([{f"_s{k}t0": d.raw for k, d in enumerate(drafts)}])
    past = {
        f"_s{k}t{a}": lay.lag(f"_s{k}t0", a) for k in range(len(signals)) for a in range(1, ages)
    }
    lay = lay.with_levels([past])
    latched = [f"_s{k}t{a}" for k, sig in enumerate(signals) if sig.latch for a in range(ages)]
    if not latched:
        return lay.own()
    lay = running(lay, {f"{t}l": ("last", F.col(t)) for t in latched})
    filled = {t: F.coalesce(f"{t}l", F.lit(0.0)) for t in latched}
    return replace(lay, df=lay.df.withColumns(filled))


def with_target(df: DataFrame, signal: Signal, series: Series = DAILY) -> DataFrame:
    """``df`` plus ``target``."""
    lay = _targets(_laid_out(df, [signal], series, 0), [signal], 1)
    return lay.df.select(*df.columns, F.col("_s0t0").alias("target"))


def held_position(df: DataFrame, by: Sequence[str] = ("symbol",), series: Series = DAILY) -> DataFrame:
    """``held`` = the target of the bar before, 0 on the first bar."""
    lay = lay_out(df, series.by(by), 1)
    held = F.coalesce(lay.lag("target"), F.lit(0.0))
    return lay.with_levels([{"held": held}]).own().df.select(*df.columns, "held")


def turnover_cost(
    df: DataFrame,
    costs: CostModel = CostModel(),
    by: Sequence[str] = ("symbol",),
    series: Series = DAILY,
) -> DataFrame:
    """``cost`` of the change in ``held`` entering each bar."""
    lay = lay_out(df, series.by(by), 1)
    before = F.coalesce(lay.lag("held"), F.lit(0.0))
    lay = lay.with_levels([{"cost": costs.turnover_cost("held", before)}])
    return lay.own().df.select(*df.columns, "cost")


def backtest_each(
    df: DataFrame,
    signals: Sequence[Signal],
    costs: CostModel = CostModel(),
    series: Series = DAILY,
) -> DataFrame:
    """Bars plus ``asset_ret`` and, for signal k, ``s{k}_target _held _cost _ret _equity``.

    One scan, one exchange and one sort serve all signals; trades follow one bar after.
    """
    lay = _laid_out(df, signals, series, 2)
    lay = lay.with_levels([{"asset_ret": ieee_div("close", lay.lag("close")) - 1}])
    lay = _targets(lay, signals, 3)
    positions: dict[str, Column] = {}
    for k in range(len(signals)):
        held = F.coalesce(f"_s{k}t1", F.lit(0.0))
        positions[f"s{k}_target"] = F.col(f"_s{k}t0")
        positions[f"s{k}_held"] = held
        positions[f"s{k}_cost"] = costs.turnover_cost(held, F.coalesce(f"_s{k}t2", F.lit(0.0)))
    out = lay.df.withColumns(positions)
    move = F.coalesce("asset_ret", F.lit(0.0))
    gains = {
        f"s{k}_ret": F.col(f"s{k}_held") * move - F.col(f"s{k}_cost") for k in range(len(signals))
    }
    out = out.withColumns(gains)
    growth = {f"s{k}_equity": ("product", 1 + F.col(f"s{k}_ret")) for k in range(len(signals))}
    lay = running(replace(lay, df=out), growth)
    parts = ("target", "held", "cost", "ret", "equity")
    names = [f"s{k}_{part}" for k in range(len(signals)) for part in parts]
    return lay.df.select(*df.columns, "asset_ret", *names)


def backtest(
    df: DataFrame,
    signal: Signal,
    costs: CostModel = CostModel(),
    series: Series = DAILY,
) -> DataFrame:
    """Bars plus ``target asset_ret held cost ret equity``."""
    out = backtest_each(df, [signal], costs, series)
    parts = [F.col(f"s0_{part}").alias(part) for part in ("held", "cost", "ret", "equity")]
    return out.select(*df.columns, F.col("s0_target").alias("target"), "asset_ret", *parts)


# Names of the statistics of a run and the summary metrics they come from.
RUN_STATS = {
    "total_return": "total_return",
    "cagr": "cagr",
    "annual_vol": "annualized_volatility",
    "sharpe": "sharpe_ratio",
    "max_drawdown": "max_drawdown",
    "calmar": "calmar_ratio",
}


def backtest_stats(
    bt: DataFrame, by: Sequence[str] = ("symbol",), series: Series = DAILY
) -> DataFrame:
    stats = summary_by_symbol(bt, "equity", by, tuple(RUN_STATS.values()), series=series)
    return stats.select(*by, *[F.col(src).alias(name) for name, src in RUN_STATS.items()])


def trades(bt: DataFrame, by: Sequence[str] = ("symbol",), series: Series = DAILY) -> DataFrame:
    """Bars on which the held weight changed."""
    lay = lay_out(bt, series.by(by), 1)
    delta = F.col("held") - F.coalesce(lay.lag("held"), F.lit(0.0))
    lay = lay.with_levels([{"delta": delta}]).own()
    return lay.df.where(F.col("delta") != 0).select(*by, "timestamp", "close", "held", "delta")
