"""Parameter sweeps: every spec over every symbol in one Spark job."""
from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.costs import CostModel
from tapeloom.functions.expr import ieee_div
from tapeloom.operators.backtest import RUN_STATS, SIGNALS, backtest_stats
from tapeloom.operators.indicators import Indicator, rsi, sma, with_indicators
from tapeloom.operators.series import DAILY, Series, lay_out, running

SPEC_SCHEMA = T.StructType(
    [
        T.StructField("strategy", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("constants", T.StringType()),
    ]
)

# Specs that one row of a grid's numbering is unfolded to.
GRID_BLOCK = 4096

# Default parameters of the families a sweep can run.
FAMILIES: dict[str, dict[str, float]] = {
    "buy_and_hold": {},
    "sma_cross": {"fast": 10, "slow": 30},
    "rsi_reversion": {"window": 14, "low": 30, "high": 70},
    "scaled_rsi": {"window": 14, "low": 30, "high": 70},
}
WINDOWED = {"sma_cross": ("fast", "slow"), "rsi_reversion": ("window",), "scaled_rsi": ("window",)}


def param_grid(
    spark: SparkSession,
    strategy: str,
    constants: Mapping[str, object] | None = None,
    label: str | None = None,
    **axes: Sequence[float],
) -> DataFrame:
    """Specs for the Cartesian product of the axes; no axes give one default spec.

    The product is of the few values the caller typed, not of data.
    """
    fixed = json.dumps(dict(constants or {}), sort_keys=True, default=str)
    rows = [
        (strategy, label, {n: float(v) for n, v in zip(axes, combo)}, fixed)
        for combo in itertools.product(*axes.values())
    ]
    return spec_key(spark.createDataFrame(rows, SPEC_SCHEMA))


def axes_grid(axes: DataFrame, constants: Mapping[str, object] | None = None, label: str | None = None) -> DataFrame:
    """Specs for the products of the axes in a table (strategy, name, value).

    The grid of a strategy is numbered, and a number's digits in the mixed radix of the axes
    choose the values, so the product is made by tasks, in blocks of GRID_BLOCK specs; only
    the distinct values of one strategy's axes meet in one row.  Repeated values count once;
    null values and names add no axis, and a strategy without an axis gives one default spec;
    rows with a null strategy are ignored.
    """
    fixed = json.dumps(dict(constants or {}), sort_keys=True, default=str)
    known = axes.where(F.col("strategy").isNotNull())
    axis = known.groupBy("strategy", "name").agg(F.array_sort(F.collect_set(F.col("value").cast("double"))).alias("choices"))
    usable = F.col("name").isNotNull() & (F.size("choices") > 0)
    grids = axis.groupBy("strategy").agg(F.array_sort(F.collect_list(F.when(usable, F.struct("name", "choices")))).alias("_axes"))
    grids = grids.withColumn("_total", F.expr("aggregate(_axes, 1L, (n, a) -> n * size(a.choices))"))
    blocks = grids.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_total - 1) div {GRID_BLOCK})")))
    blocks = blocks.repartition("strategy", "_block")
    first = F.col("_block") * GRID_BLOCK
    last = F.least(F.col("_total"), first + GRID_BLOCK) - 1
    numbered = blocks.withColumn("_number", F.explode(F.sequence(first, last)))
    params = F.expr(
        """aggregate(
            _axes,
            named_struct('rest', _number, 'chosen', cast(array() AS array<struct<name: string, value: double>>)),
            (acc, a) -> named_struct(
                'rest', acc.rest div size(a.choices),
                'chosen', concat(acc.chosen, array(named_struct(
                    'name', a.name, 'value', a.choices[cast(acc.rest % size(a.choices) AS int)])))),
            acc -> map_from_entries(acc.chosen))"""
    )
    return spec_key(
        numbered.select("strategy", F.lit(label).cast("string").alias("label"), params.alias("params"), F.lit(fixed).alias("constants"))
    )


def spec_key(specs: DataFrame) -> DataFrame:
    """Adds ``spec_key``: 12 hex digits of the SHA-1 of the spec in a canonical order."""
    ordered = F.array_sort(F.map_entries("params"))
    form = F.to_json(
        F.struct("strategy", "label", F.map_from_entries(ordered).alias("params"), "constants")
    )
    return specs.withColumn("spec_key", F.substring(F.sha1(form), 1, 12))


def _param(name: str, default: float) -> Column:
    return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(float(default)))


def sweep_failures(specs: DataFrame) -> DataFrame:
    """Specs plus ``error``: NULL for a runnable one, else what is wrong with it."""
    known = F.col("strategy").isin(*SIGNALS)
    names = F.lit(", ".join(sorted(SIGNALS)))
    error = F.when(
        ~known, F.concat(F.lit("unknown strategy "), F.col("strategy"), F.lit("; known: "), names)
    )
    for family, defaults in FAMILIES.items():
        mine = F.col("strategy") == family
        allowed = F.array(*[F.lit(n) for n in defaults]) if defaults else F.array().cast("array<string>")
        extra = F.array_except(F.map_keys("params"), allowed)
        error = F.when(
            mine & (F.size(extra) > 0),
            F.concat(F.lit("unknown parameters: "), F.array_join(F.array_sort(extra), ", ")),
        ).otherwise(error)
        for name in WINDOWED.get(family, ()):
            value = _param(name, defaults[name])
            bad = (value < 1) | (value != F.floor(value))
            error = F.when(mine & bad, F.lit(f"{name} must be a positive integer")).otherwise(error)
    return specs.withColumn("error", error)


def _needs(specs: DataFrame) -> tuple[list[str | None], list[int], list[int]]:
    """What the specs ask of the bars: distinct constants, lengths of means, lengths of RSI.

    These distinct values reach the driver, the specs themselves do not.
    """

    def asked(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    def length(family: str, name: str) -> Column:
        return _param(name, FAMILIES[family][name]).cast("int")

    constants = asked("constants", F.col("constants"))
    crossing = F.col("strategy") == "sma_cross"
    reverting = F.col("strategy").isin("rsi_reversion", "scaled_rsi")
    each = (
        F.when(crossing, F.array(constants, asked("mean", length("sma_cross", "fast")), asked("mean", length("sma_cross", "slow"))))
        .when(reverting, F.array(constants, asked("rsi", length("rsi_reversion", "window"))))
        .otherwise(F.array(constants))
    )
    found = specs.select(F.explode(each).alias("n")).select("n.*").distinct().collect()
    texts = sorted((r.value for r in found if r.kind == "constants"), key=lambda text: text or "")
    means, strengths = (sorted(int(r.value) for r in found if r.kind == kind) for kind in ("mean", "rsi"))
    return texts, means, strengths


def _raw_target(families: set[str]) -> Column:
    """Target of a (spec, bar) row before latching; NULL keeps the state."""
    level = F.col("_rsi")
    low, high = _param("low", 30), _param("high", 70)
    ramp = (high - level) / (high - low)
    ramp = F.least(F.greatest(ramp, F.lit(0.0)), F.lit(1.0))
    rules = {
        "buy_and_hold": F.lit(1.0),
        "sma_cross": F.when(F.col("_fast") > F.col("_slow"), 1.0).otherwise(0.0),
        "rsi_reversion": F.when(level < low, 1.0).when(level > high, 0.0),
        "scaled_rsi": F.when(level.isNull() | F.isnan(level), F.lit(0.0)).otherwise(ramp),
    }
    out = F.lit(None).cast("double")
    for family in sorted(families):
        out = F.when(F.col("strategy") == family, rules[family]).otherwise(out)
    return out


def _constants(text: str | None) -> dict:
    return json.loads(text) if text else {}


Setting = tuple[tuple[str, ...] | None, str | None, str | None, str | None]


def _setting(text: str | None) -> Setting:
    """(universe, start, end, interval) of a spec."""
    fixed = _constants(text)
    universe = fixed.get("universe")
    return (None if universe is None else tuple(universe), fixed.get("start"), fixed.get("end"), fixed.get("interval"))


def _taken(setting: Setting, columns: Sequence[str]) -> Column:
    """Whether a bar belongs to the data of a setting."""
    universe, start, end, interval = setting
    out = F.lit(True)
    if universe is not None:
        out = out & F.col("symbol").isin(list(universe))
    if start is not None:
        out = out & (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))
    if interval is not None and "interval" in columns:
        out = out & (F.col("interval") == interval)
    return out


def sweep_backtest(
    df: DataFrame, specs: DataFrame, costs: CostModel = CostModel(), series: Series = DAILY
) -> DataFrame:
    """Backtest frames of all runnable specs, keyed by (spec_key, symbol).

    A spec's ``constants`` can set ``universe`` (symbols), ``start`` and ``end`` (half-open),
    ``interval`` and ``costs`` (fields of the cost model).  Each distinct window is computed
    once per bar and setting and looked up per spec; the backtest runs per (spec_key, symbol).
    """
    runnable = sweep_failures(specs).where(F.col("error").isNull())
    texts, means, strengths = _needs(runnable)
    settings = [_setting(text) for text in texts]
    distinct = list(dict.fromkeys(settings))
    rows = []
    for text, setting in zip(texts, settings):
        own = replace(costs, **_constants(text).get("costs", {}))
        rows.append((text, distinct.index(setting), float(own.commission + own.transfer + own.slippage), float(own.stamp)))
    rates = df.sparkSession.createDataFrame(rows, "_text string, _setting int, _both double, _stamp double")
    numbered = runnable.join(rates, F.col("constants").eqNullSafe(F.col("_text"))).select(
        "_setting", "spec_key", "strategy", "params", "_both", "_stamp"
    )
    wanted: list[Indicator] = [sma(window=n).named(f"_m{n}") for n in means]
    wanted += [rsi(window=n).named(f"_r{n}") for n in strengths]
    # Every bar once per setting that takes it, so that warm-up starts where the setting does.
    marks = [F.when(_taken(setting, df.columns), F.lit(n)) for n, setting in enumerate(distinct)]
    taken = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<int>")
    bars = df.withColumn("_setting", F.explode(taken))
    panel = with_indicators(bars, wanted, series.by(("_setting", *series.keys))) if wanted else bars

    def lookup(prefix: str, windows: list[int], length: Column) -> Column:
        if not windows:
            return F.lit(None).cast("double")
        pairs = [x for n in windows for x in (F.lit(n), F.col(f"{prefix}{n}"))]
        return F.try_element_at(F.create_map(*pairs), length.cast("int"))

    fanned = panel.join(numbered, "_setting").withColumns(
        {
            "_fast": lookup("_m", means, _param("fast", 10)),
            "_slow": lookup("_m", means, _param("slow", 30)),
            "_rsi": lookup("_r", strengths, _param("window", 14)),
        }
    )
    fanned = fanned.withColumn("_raw", _raw_target(set(FAMILIES)))
    # Partitioned anew: by symbol alone, all specs of a symbol would share a task.
    fanned = fanned.select(*df.columns, "spec_key", "_raw", "_both", "_stamp").repartition("spec_key", *series.keys)
    lay = lay_out(fanned, series.by(("spec_key", *series.keys)), 2)
    lags = {f"_t{a}": lay.lag("_raw", a) for a in (1, 2)}
    lay = lay.with_levels([{**lags, "asset_ret": ieee_div("close", lay.lag("close")) - 1}])
    names = {"target": "_raw", "held": "_t1", "_before": "_t2"}
    lay = running(lay, {n: ("last", F.col(src)) for n, src in names.items()})
    rows = lay.df.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    sold = F.greatest(F.col("_before") - F.col("held"), F.lit(0.0))
    rows = rows.withColumn("cost", F.abs(F.col("held") - F.col("_before")) * F.col("_both") + sold * F.col("_stamp"))
    gain = F.col("held") * F.coalesce("asset_ret", F.lit(0.0)) - F.col("cost")
    rows = rows.withColumn("ret", gain)
    lay = running(replace(lay, df=rows), {"equity": ("product", 1 + F.col("ret"))})
    return lay.df.select(
        "spec_key", *df.columns, "target", "asset_ret", "held", "cost", "ret", "equity"
    )


def sweep(
    df: DataFrame, specs: DataFrame, costs: CostModel = CostModel(), series: Series = DAILY
) -> DataFrame:
    """Statistics per (spec_key, symbol)."""
    frames = sweep_backtest(df, specs, costs, series)
    return backtest_stats(frames, ("spec_key", "symbol"), series)


def sweep_frame(specs: DataFrame, stats: DataFrame, params: Sequence[str]) -> DataFrame:
    """One row per spec (and symbol): key, strategy, label, ``param_*``, error, statistics."""
    judged = sweep_failures(specs)
    columns = [F.try_element_at("params", F.lit(p)).alias(f"param_{p}") for p in params]
    return judged.join(stats, "spec_key", "left").select(
        "spec_key", "strategy", "label", *columns, "error",
        *[c for c in stats.columns if c != "spec_key"],
    )


def sweep_best(
    frame: DataFrame, metric: str = "sharpe", maximize: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Best successful row, overall or per group: an aggregate, no sort of the frame."""
    if metric not in RUN_STATS and metric not in frame.columns:
        raise ValueError(f"unknown metric {metric!r}")
    value = F.col(metric)
    scored = frame.where(F.col("error").isNull() & value.isNotNull() & ~F.isnan(value))
    rank = F.struct((value if maximize else -value).alias("v"), F.hex("spec_key").alias("k"))
    best = F.max_by(F.struct(*frame.columns), rank).alias("_best")
    out = scored.groupBy(*by).agg(best) if by else scored.agg(best)
    return out.where(F.col("_best").isNotNull()).select("_best.*")
