"""Per-bar technical indicators.

An indicator is a small recipe over a laid-out series: levels of window columns,
running scans, and a result column.  ``metric_panel`` merges the recipes of any number
of indicators, so that a whole panel shares one shuffle and one sort by key.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.expr import as_col, ieee_div
from tapeloom.operators.series import (
    DAILY,
    Layout,
    Scan,
    Series,
    averaged,
    lay_out,
    running,
)


# Exponential averages ``name: (x, alpha)``, and columns of the same row that use them.
Averages = tuple[dict[str, tuple[Column, float]], dict[str, Column]]


@dataclass(frozen=True)
class Recipe:
    """Levels over earlier rows first, then averages and scans over the whole series."""

    result: Column
    levels: list[dict[str, Column]] = field(default_factory=list)
    scans: dict[str, Scan] = field(default_factory=dict)
    averages: list[Averages] = field(default_factory=list)


@dataclass(frozen=True)
class Indicator:
    """``cook(layout, prefix)`` gives the recipe; temporary columns start with the prefix."""

    alias: str
    lookback: int
    cook: Callable[[Layout, str], Recipe]
    fields: tuple[str, ...] = ()

    def named(self, alias: str) -> Indicator:
        return replace(self, alias=alias)


# --- returns -----------------------------------------------------------------


def _change(x: Column, past: Column) -> Column:
    return ieee_div(x, past) - 1


def simple_return(column: str = "close", periods: int = 1) -> Indicator:
    return Indicator(
        "simple_return",
        periods,
        lambda lay, p: Recipe(_change(F.col(column), lay.lag(column, periods))),
    )


def log_return(column: str = "close", periods: int = 1) -> Indicator:
    return Indicator(
        "log_return",
        periods,
        lambda lay, p: Recipe(F.log(ieee_div(column, lay.lag(column, periods)))),
    )


def cumulative_return(column: str = "close") -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        return Recipe(
            _change(F.col(column), F.col(f"{p}_first")),
            scans={f"{p}_first": ("first", F.col(column))},
        )

    return Indicator("cumulative_return", 0, cook)


def drawdown(column: str = "close") -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        return Recipe(
            _change(F.col(column), F.col(f"{p}_peak")),
            scans={f"{p}_peak": ("max", F.col(column))},
        )

    return Indicator("drawdown", 0, cook)


# --- trend -------------------------------------------------------------------


def sma(column: str = "close", window: int = 20) -> Indicator:
    return Indicator("sma", window - 1, lambda lay, p: Recipe(lay.rolling(F.avg, column, window)))


def ema(column: str = "close", span: int = 20) -> Indicator:
    alpha = 2.0 / (span + 1)
    return Indicator(
        "ema",
        0,
        lambda lay, p: Recipe(F.col(f"{p}_e"), averages=[({f"{p}_e": (F.col(column), alpha)}, {})]),
    )


def wma(column: str = "close", window: int = 20) -> Indicator:
    """Weights 1..n: with row numbers i, sum(i x) minus (i_now - n) sum(x), normalised."""

    def cook(lay: Layout, p: str) -> Recipe:
        row, shifted = F.col(f"{p}_row"), f"{p}_ix"
        plain, weighted = lay.rolling(F.sum, column, window), lay.rolling(F.sum, shifted, window)
        return Recipe(
            (weighted - (row - window) * plain) / (window * (window + 1) / 2),
            [
                {f"{p}_row": F.row_number().over(lay.rows)},
                {shifted: row * F.col(column)},
            ],
        )

    return Indicator("wma", window - 1, cook)


def macd(column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> Indicator:
    a_fast, a_slow, a_signal = (2.0 / (n + 1) for n in (fast, slow, signal))

    def cook(lay: Layout, p: str) -> Recipe:
        line, smooth = F.col(f"{p}_line"), F.col(f"{p}_sig")
        pair = {f"{p}_fast": (F.col(column), a_fast), f"{p}_slow": (F.col(column), a_slow)}
        return Recipe(
            F.struct(line.alias("macd"), smooth.alias("signal"), (line - smooth).alias("histogram")),
            averages=[
                (pair, {f"{p}_line": F.col(f"{p}_fast") - F.col(f"{p}_slow")}),
                ({f"{p}_sig": (line, a_signal)}, {}),
            ],
        )

    return Indicator("macd", 0, cook, ("macd", "signal", "histogram"))


# --- momentum ----------------------------------------------------------------


def roc(column: str = "close", periods: int = 10) -> Indicator:
    return Indicator(
        "roc",
        periods,
        lambda lay, p: Recipe(_change(F.col(column), lay.lag(column, periods)) * 100),
    )


def momentum(column: str = "close", periods: int = 10) -> Indicator:
    return Indicator(
        "momentum", periods, lambda lay, p: Recipe(F.col(column) - lay.lag(column, periods))
    )


def rsi_recipe(lay: Layout, p: str, column: str, window: int) -> Recipe:
    """Wilder's RSI: 100 - 100 / (1 + average gain / average loss)."""
    move, alpha = F.col(f"{p}_move"), 1.0 / window
    up = F.when(move > 0, move).otherwise(F.lit(0.0))
    down = F.when(move < 0, -move).otherwise(F.lit(0.0))
    pair = {f"{p}_gain": (F.col(f"{p}_up"), alpha), f"{p}_loss": (F.col(f"{p}_down"), alpha)}
    ratio = ieee_div(f"{p}_gain", f"{p}_loss")
    return Recipe(
        F.col(f"{p}_rsi"),
        [{f"{p}_move": F.col(column) - lay.lag(column)}, {f"{p}_up": up, f"{p}_down": down}],
        averages=[(pair, {f"{p}_rsi": 100 - ieee_div(F.lit(100.0), 1 + ratio)})],
    )


def rsi(column: str = "close", window: int = 14) -> Indicator:
    return Indicator("rsi", 1, lambda lay, p: rsi_recipe(lay, p, column, window))


#: Up to this window a sliding frame, which reads the window again for each row, is cheaper.
SLIDING = 64


def rolling_extremes(lay: Layout, p: str, specs: dict[str, tuple[str, str]], window: int) -> list[dict[str, Column]]:
    """Levels that add ``name: (max or min, column)`` over the last ``window`` rows, NULL until full.

    For long windows rows are cut into stretches as long as the window: a window reaches from
    the end of one stretch into the next, so its extreme is that of a running extreme towards
    the stretch's end, looked up ``window - 1`` rows before, and of one from the start of the
    row's own stretch.  The cost of a row does not depend on the window.
    """
    pick, either = {"max": F.max, "min": F.min}, {"max": F.greatest, "min": F.least}
    if window <= SLIDING:
        return [{name: lay.rolling(pick[kind], column, window) for name, (kind, column) in specs.items()}]
    stretch = (*lay.parts, F.floor((F.col(f"{p}_at") - 1) / window))
    first, last = Window.unboundedPreceding, Window.currentRow
    onwards = Window.partitionBy(*stretch).orderBy(*lay.series.order).rowsBetween(first, last)
    backwards = Window.partitionBy(*stretch).orderBy(*[F.desc(c) for c in lay.series.order]).rowsBetween(first, last)
    so_far = lay.rows.rowsBetween(first, last)
    counts = {f"{p}_of_{c}": F.count(c).over(so_far) for c in {c for _, c in specs.values()}}
    from_start = {f"{n}_on": pick[kind](c).over(onwards) for n, (kind, c) in specs.items()}
    to_end = {f"{n}_back": pick[kind](c).over(backwards) for n, (kind, c) in specs.items()}

    def full(column: str) -> Column:
        seen = F.col(f"{p}_of_{column}")
        return seen - F.coalesce(lay.lag(seen, window), F.lit(0)) == window

    extremes = {
        n: F.when(full(c), either[kind](f"{n}_on", lay.lag(f"{n}_back", window - 1))) for n, (kind, c) in specs.items()
    }
    return [{f"{p}_at": F.row_number().over(lay.rows), **counts}, from_start, to_end, extremes]


def stochastic_oscillator(
    window: int = 14, smooth: int = 3, high: str = "high", low: str = "low", close: str = "close"
) -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        k = F.col(f"{p}_k")
        return Recipe(
            F.struct(k.alias("percent_k"), lay.rolling(F.avg, k, smooth).alias("percent_d")),
            [
                *rolling_extremes(lay, p, {f"{p}_bot": ("min", low), f"{p}_top": ("max", high)}, window),
                {
                    f"{p}_k": ieee_div(
                        100 * (F.col(close) - F.col(f"{p}_bot")),
                        F.col(f"{p}_top") - F.col(f"{p}_bot"),
                    )
                },
            ],
        )

    return Indicator("stochastic", window + smooth - 2, cook, ("percent_k", "percent_d"))


def williams_r(
    window: int = 14, high: str = "high", low: str = "low", close: str = "close"
) -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        top, bottom = F.col(f"{p}_top"), F.col(f"{p}_bot")
        return Recipe(
            ieee_div(-100 * (top - F.col(close)), top - bottom),
            rolling_extremes(lay, p, {f"{p}_top": ("max", high), f"{p}_bot": ("min", low)}, window),
        )

    return Indicator("williams_r", window - 1, cook)


def _typical(high: str, low: str, close: str) -> Column:
    return (F.col(high) + F.col(low) + F.col(close)) / 3


def cci(window: int = 20, high: str = "high", low: str = "low", close: str = "close") -> Indicator:
    """Deviation of each bar from its own mean, so the first value needs 2n-1 bars."""

    def cook(lay: Layout, p: str) -> Recipe:
        gap = F.col(f"{p}_gap")
        return Recipe(
            ieee_div(gap, 0.015 * F.col(f"{p}_dev")),
            [
                {f"{p}_tp": _typical(high, low, close)},
                {f"{p}_gap": F.col(f"{p}_tp") - lay.rolling(F.avg, f"{p}_tp", window)},
                {f"{p}_dev": lay.rolling(F.avg, F.abs(gap), window)},
            ],
        )

    return Indicator("cci", 2 * window - 2, cook)


# --- volatility --------------------------------------------------------------


def _true_range(lay: Layout, high: str, low: str, close: str) -> Column:
    before = lay.lag(close)
    return F.greatest(
        F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)
    )


def true_range(high: str = "high", low: str = "low", close: str = "close") -> Indicator:
    return Indicator("true_range", 1, lambda lay, p: Recipe(_true_range(lay, high, low, close)))


def atr(window: int = 14, high: str = "high", low: str = "low", close: str = "close") -> Indicator:
    alpha = 1.0 / window

    def cook(lay: Layout, p: str) -> Recipe:
        return Recipe(
            F.col(f"{p}_e"),
            [{f"{p}_tr": _true_range(lay, high, low, close)}],
            averages=[({f"{p}_e": (F.col(f"{p}_tr"), alpha)}, {})],
        )

    return Indicator("atr", 1, cook)


def bollinger_bands(column: str = "close", window: int = 20, num_std: float = 2.0) -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        mid, dev = F.col(f"{p}_mid"), F.col(f"{p}_std")
        return Recipe(
            F.struct(
                mid.alias("middle"),
                (mid + num_std * dev).alias("upper"),
                (mid - num_std * dev).alias("lower"),
            ),
            [
                {
                    f"{p}_mid": lay.rolling(F.avg, column, window),
                    f"{p}_std": lay.rolling(F.stddev_samp, column, window),
                }
            ],
        )

    return Indicator("bollinger", window - 1, cook, ("middle", "upper", "lower"))


def rolling_volatility(column: str = "close", window: int = 20, periods: int = 1) -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        return Recipe(
            lay.rolling(F.stddev_samp, f"{p}_lr", window),
            [{f"{p}_lr": F.log(ieee_div(column, lay.lag(column, periods)))}],
        )

    return Indicator("rolling_volatility", window - 1 + periods, cook)


# --- volume ------------------------------------------------------------------


def typical_price(high: str = "high", low: str = "low", close: str = "close") -> Indicator:
    return Indicator("typical_price", 0, lambda lay, p: Recipe(_typical(high, low, close)))


def obv(close: str = "close", volume: str = "volume") -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        flow = F.coalesce(F.signum(F.col(close) - lay.lag(close)), F.lit(0.0)) * F.col(volume)
        return Recipe(
            F.col(f"{p}_obv"), [{f"{p}_flow": flow}], {f"{p}_obv": ("sum", F.col(f"{p}_flow"))}
        )

    return Indicator("obv", 1, cook)


def vwap(
    high: str = "high", low: str = "low", close: str = "close", volume: str = "volume"
) -> Indicator:
    def cook(lay: Layout, p: str) -> Recipe:
        return Recipe(
            ieee_div(f"{p}_pv", f"{p}_v"),
            scans={
                f"{p}_pv": ("sum", _typical(high, low, close) * F.col(volume)),
                f"{p}_v": ("sum", F.col(volume)),
            },
        )

    return Indicator("vwap", 0, cook)


def volume_sma(window: int = 20, volume: str = "volume") -> Indicator:
    return sma(volume, window).named("volume_sma")


# --- panel -------------------------------------------------------------------

REGISTRY: dict[str, Callable[..., Indicator]] = {
    "simple_return": simple_return,
    "log_return": log_return,
    "cumulative_return": cumulative_return,
    "drawdown": drawdown,
    "sma": sma,
    "ema": ema,
    "wma": wma,
    "macd": macd,
    "roc": roc,
    "momentum": momentum,
    "rsi": rsi,
    "stochastic_oscillator": stochastic_oscillator,
    "williams_r": williams_r,
    "cci": cci,
    "true_range": true_range,
    "atr": atr,
    "bollinger_bands": bollinger_bands,
    "rolling_volatility": rolling_volatility,
    "typical_price": typical_price,
    "obv": obv,
    "vwap": vwap,
    "volume_sma": volume_sma,
}


def zip_levels(*chains: list[dict[str, Column]]) -> list[dict[str, Column]]:
    merged: list[dict[str, Column]] = []
    for depth in range(max(map(len, chains), default=0)):
        level: dict[str, Column] = {}
        for chain in chains:
            if depth < len(chain):
                level.update(chain[depth])
        merged.append(level)
    return merged


def with_averages(lay: Layout, recipes: Sequence[Recipe]) -> Layout:
    """The averages of all recipes, those of one depth together."""
    for depth in range(max((len(r.averages) for r in recipes), default=0)):
        stage = [r.averages[depth] for r in recipes if depth < len(r.averages)]
        lay = averaged(lay, {name: spec for averages, _ in stage for name, spec in averages.items()})
        lay = lay.with_levels([{name: value for _, after in stage for name, value in after.items()}])
    return lay


def with_indicators(
    df: DataFrame, indicators: Iterable[Indicator], series: Series = DAILY, unnest: bool = True
) -> DataFrame:
    """``df`` plus one column per indicator (several, ``alias_field``, for struct results)."""
    wanted = list(indicators)
    base = df.columns
    lay = lay_out(df, series, max((i.lookback for i in wanted), default=0))
    recipes = [i.cook(lay, f"_i{n}") for n, i in enumerate(wanted)]
    lay = lay.with_levels(zip_levels(*[r.levels for r in recipes]))
    late = [bool(r.scans or r.averages) for r in recipes]
    lay = lay.with_levels([{i.alias: r.result for i, r, x in zip(wanted, recipes, late) if not x}])
    lay = with_averages(lay, recipes)
    scans = {name: scan for r in recipes for name, scan in r.scans.items()}
    done = running(lay, scans).df
    done = done.withColumns({i.alias: r.result for i, r, x in zip(wanted, recipes, late) if x})
    cols: list[Column] = [F.col(c) for c in base]
    for i in wanted:
        if i.fields and unnest:
            cols += [F.col(i.alias)[f].alias(f"{i.alias}_{f}") for f in i.fields]
        else:
            cols.append(F.col(i.alias))
    return done.select(*cols)


def metric_panel(
    df: DataFrame, metrics: Sequence[tuple[str, dict, str]], series: Series = DAILY
) -> DataFrame:
    """Apply named metrics ``(name, params, alias)`` in one pass."""
    unknown = sorted({name for name, _, _ in metrics} - REGISTRY.keys())
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(REGISTRY)}")
    return with_indicators(df, [REGISTRY[n](**ps).named(a) for n, ps, a in metrics], series)
