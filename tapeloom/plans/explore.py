"""Panels for comparing strategies and exploring indicators."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.costs import CostModel
from tapeloom.operators.backtest import backtest_each, backtest_stats, build_signal
from tapeloom.operators.indicators import metric_panel
from tapeloom.operators.series import DAILY, Series
from tapeloom.operators.summary import summary_by_symbol


def multi_strategy_compare(
    df: DataFrame,
    strategies: Sequence[tuple[str, Mapping[str, object]]],
    costs: CostModel = CostModel(),
    series: Series = DAILY,
) -> DataFrame:
    """Statistics per (strategy, symbol), one row each.

    All strategies run side by side over one sorted pass; their equity columns are then
    stacked in place, which keeps the partitioning by symbol.
    """
    signals = [build_signal(name, params) for name, params in strategies]
    runs = backtest_each(df, signals, costs, series)
    stacked = F.array(
        *[
            F.struct(F.lit(s.name).alias("strategy"), F.col(f"s{k}_equity").alias("equity"))
            for k, s in enumerate(signals)
        ]
    )
    rows = runs.select("symbol", "timestamp", F.explode(stacked).alias("_run"))
    rows = rows.select("symbol", "timestamp", "_run.*")
    return backtest_stats(rows, ("strategy", "symbol"), series)


def explorer_panel(
    df: DataFrame, metrics: Sequence[tuple[str, dict, str]], series: Series = DAILY
) -> tuple[DataFrame, DataFrame]:
    """(bars with indicators, summary statistics per symbol)."""
    return metric_panel(df, metrics, series), summary_by_symbol(df, series=series)
