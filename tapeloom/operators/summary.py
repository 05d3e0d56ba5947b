"""Risk and return statistics of a series, one row per key."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.expr import ieee_div
from tapeloom.operators.series import DAILY, Series, lay_out

ALL_METRICS = (
    "total_return",
    "cagr",
    "annualized_volatility",
    "sharpe_ratio",
    "sortino_ratio",
    "max_drawdown",
    "calmar_ratio",
)


def _moments(df: DataFrame, column: str, series: Series) -> DataFrame:
    """Per key: n, n_ret, mean, m2, down2, start, end, mdd (via block rows when unbounded)."""
    lay = lay_out(df, series, 1)
    x = F.col(column)
    lay = lay.with_levels([{"_ret": ieee_div(x, lay.lag(x)) - 1}]).own()
    so_far = lay.rows.rowsBetween(Window.unboundedPreceding, 0)
    lay = lay.with_levels([{"_peak": F.max(x).over(so_far)}])
    position, r = series.position(), F.col("_ret")
    part = lay.df.groupBy(*lay.parts).agg(
        F.count(x).alias("n"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(r).alias("n_ret"),
        F.avg(r).alias("mean"),
        (F.var_pop(r) * F.count(r)).alias("m2"),
        F.sum(F.when(r < 0, r * r).otherwise(F.lit(0.0))).alias("down2"),
        F.min_by(x, position).alias("start"),
        F.max_by(x, position).alias("end"),
        F.min(ieee_div(x, "_peak") - 1).alias("mdd"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )
    if lay.whole:
        return part
    ahead = (
        Window.partitionBy(*series.keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    part = part.withColumn("prior", F.max("high").over(ahead))
    n, mean = F.col("n_ret"), F.col("mean")
    return (
        part.groupBy(*series.keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_rows").alias("n_rows"),
            F.sum(n).alias("n_all"),
            (F.sum(n * mean) / F.nullif(F.sum(n), F.lit(0))).alias("mean_all"),
            F.sum("m2").alias("m2_in"),
            F.sum(n * mean * mean).alias("sq"),
            F.sum("down2").alias("down2"),
            F.min_by("start", "_block").alias("start"),
            F.max_by("end", "_block").alias("end"),
            F.least(F.min("mdd"), F.min(ieee_div("low", "prior") - 1)).alias("mdd"),
        )
        .withColumn(
            "m2",
            F.greatest(
                F.lit(0.0),
                F.col("m2_in") + F.col("sq") - F.col("n_all") * F.col("mean_all") * F.col("mean_all"),
            ),
        )
        .withColumnsRenamed({"n_all": "n_ret", "mean_all": "mean"})
    )


def _formulas(periods_per_year: int, risk_free_rate: float) -> dict[str, Column]:
    year, n_ret, mean = float(periods_per_year), F.col("n_ret"), F.col("mean")
    growth = ieee_div("end", "start")
    std = F.when(n_ret > 1, F.sqrt(F.col("m2") / (n_ret - 1)))
    excess = mean - risk_free_rate / year
    cagr = F.when(F.col("n") > 1, F.pow(growth, ieee_div(F.lit(year), F.col("n") - 1)) - 1)
    return {
        "total_return": growth - 1,
        "cagr": cagr,
        "annualized_volatility": std * math.sqrt(year),
        "sharpe_ratio": ieee_div(excess, std) * math.sqrt(year),
        "sortino_ratio": ieee_div(excess, F.sqrt(F.col("down2") / F.col("n_rows"))) * math.sqrt(year),
        "max_drawdown": F.col("mdd"),
        "calmar_ratio": ieee_div(cagr, F.abs("mdd")),
    }


def summary_by_symbol(
    df: DataFrame,
    column: str = "close",
    by: Sequence[str] = ("symbol",),
    metrics: Sequence[str] = ALL_METRICS,
    periods_per_year: int = 252,
    risk_free_rate: float = 0.0,
    series: Series = DAILY,
) -> DataFrame:
    """Any of ``ALL_METRICS`` of ``column`` per key; one shuffle serves all of them."""
    unknown = sorted(set(metrics) - set(ALL_METRICS))
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {list(ALL_METRICS)}")
    formulas = _formulas(periods_per_year, risk_free_rate)
    return _moments(df, column, series.by(by)).select(*by, *[formulas[m].alias(m) for m in metrics])


def _single(metric: str):
    def run(df: DataFrame, column: str = "close", by: Sequence[str] = ("symbol",), **options) -> DataFrame:
        return summary_by_symbol(df, column, by, (metric,), **options)

    run.__name__ = metric
    run.__doc__ = f"``{metric}`` of ``column`` per key; options as in ``summary_by_symbol``."
    return run


total_return = _single("total_return")
cagr = _single("cagr")
annualized_volatility = _single("annualized_volatility")
sharpe_ratio = _single("sharpe_ratio")
sortino_ratio = _single("sortino_ratio")
max_drawdown = _single("max_drawdown")
calmar_ratio = _single("calmar_ratio")
