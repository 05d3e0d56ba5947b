from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest

from tapeloom.functions.costs import FREE, CostModel
from tapeloom.operators import backtest as bt
from tapeloom.operators.series import Series
from tapeloom.sources import tables
from tapeloom.plans import explore, sweep

approx = pytest.approx
BLOCKS = Series(step="1m", cuts=31)


def scripted(*targets):
    """A signal that replays the given weights by bar number."""
    from pyspark.sql import functions as F

    def cook(lay, p):
        place = F.row_number().over(lay.rows)
        return bt.Draft(F.element_at(F.array(*[F.lit(float(t)) for t in targets]), F.col(f"{p}_n")), [{f"{p}_n": place}])

    return bt.Signal("scripted", 0, cook)


def test_free_buy_and_hold_follows_the_price(bars, column):
    closes = [10, 11, 12, 9, 15]
    out = bt.backtest(bars(closes), bt.buy_and_hold(), FREE)
    assert column(out, "equity")[-1] == approx(1.5)


def test_position_lags_one_bar(bars, column):
    out = bt.backtest(bars([10, 11, 12]), bt.buy_and_hold(), FREE)
    assert column(out, "held") == [0, 1, 1]


def test_stamp_tax_only_on_the_sell(bars, column):
    costs = CostModel(0, 0.001, 0, 0, 0, 0)
    out = bt.backtest(bars([10, 10, 10, 10, 10]), scripted(1, 1, 0, 0, 0), costs)
    assert column(out, "cost") == approx([0, 0, 0, 0.001, 0])


def test_trades_are_the_changes(bars):
    out = bt.trades(bt.backtest(bars([10, 10, 10, 10]), scripted(1, 1, 0, 0), FREE))
    assert sorted(r.delta for r in out.collect()) == [-1, 1]


def test_trade_cost(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        CostModel(0, 0, 0, 0, 0.1, 0).trade_cost(F.lit(10000.0), F.lit(False), F.lit(0.01)).alias("low"),
        CostModel(0, 0, 0, 0, 0.1, 0).trade_cost(F.lit(10000.0), F.lit(False), F.lit(0.04)).alias("high"),
        CostModel().trade_cost(F.lit(1000.0), F.lit(True), F.lit(0.0)).alias("floor"),
    ).first()
    assert (row.low, row.high) == approx((100, 200))
    assert row.floor == approx(5 + 1000 * 0.00011 + 0.5)


def test_rsi_reversion_latches(bars, column):
    closes = [100 + 10 * math.sin(i / 5) for i in range(90)]
    target = column(bt.with_target(bars(closes), bt.rsi_reversion()), "target")
    assert set(target) == {0.0, 1.0} and target[0] == 0.0


def test_scaled_rsi_is_fractional(bars, column):
    closes = [100 + 10 * math.sin(i / 5) for i in range(90)]
    target = column(bt.with_target(bars(closes), bt.scaled_rsi()), "target")
    assert all(0 <= t <= 1 for t in target) and any(0 < t < 1 for t in target)


def test_build_signal_names_the_known():
    assert bt.build_signal("sma_cross", {"fast": 3}).name == "sma_cross_3_30"
    with pytest.raises(ValueError, match="buy_and_hold"):
        bt.build_signal("guess")


def test_short_history_is_flat(bars, column):
    assert column(bt.with_target(bars([1, 2, 3]), bt.sma_cross()), "target") == [0, 0, 0]


@pytest.mark.parametrize("make", [bt.sma_cross, bt.rsi_reversion, bt.scaled_rsi])
def test_blocks_agree(bars, make):
    df = bars([100 + 10 * math.sin(i / 5) + i % 7 for i in range(300)], interval="1m")
    df = df.unionByName(bars([50 + i % 11 for i in range(40)], "B", "1m"))
    frames = []
    for series in (Series(), BLOCKS):
        out = bt.backtest(df, make(), series=series).toPandas()
        frames.append(out.sort_values(["symbol", "timestamp"]))
    for name in ("target", "held", "cost", "ret", "equity"):
        np.testing.assert_allclose(frames[0][name], frames[1][name], rtol=1e-9, err_msg=name)


def test_grid_and_keys(spark):
    specs = sweep.param_grid(spark, "sma_cross", fast=[5, 10, 20], slow=[30, 60])
    again = sweep.param_grid(spark, "sma_cross", slow=[60, 30], fast=[20, 10, 5])
    keys = {r.spec_key for r in specs.collect()}
    assert len(keys) == 6 and keys == {r.spec_key for r in again.collect()}
    assert sweep.param_grid(spark, "buy_and_hold").count() == 1


def test_sweep_equals_single_runs_and_isolates_failures(spark, bars):
    df = bars([100 + 10 * math.sin(i / 5) for i in range(90)])
    df = df.unionByName(bars([80 + i % 13 for i in range(90)], "B"))
    specs = sweep.param_grid(spark, "sma_cross", fast=[3, 5], slow=[9])
    specs = specs.unionByName(sweep.param_grid(spark, "rsi_reversion", window=[7]))
    specs = specs.unionByName(sweep.param_grid(spark, "guess"))
    specs = specs.unionByName(sweep.param_grid(spark, "sma_cross", fast=[0]))
    frame = sweep.sweep_frame(specs, sweep.sweep(df, specs), ("fast", "slow", "window"))
    rows = frame.collect()
    assert len(rows) == 2 * 2 + 2 + 1 + 1
    assert {r.error is None for r in rows if r.strategy == "guess"} == {False}
    for row in rows:
        if row.error or row.strategy != "sma_cross":
            continue
        single = bt.backtest(df, bt.sma_cross(int(row.param_fast), int(row.param_slow)))
        want = {r.symbol: r for r in bt.backtest_stats(single).collect()}[row.symbol]
        assert row.total_return == approx(want.total_return) and row.sharpe == approx(want.sharpe)
    best = sweep.sweep_best(frame.where("symbol = 'A'"), "total_return").first()
    assert best.total_return == max(r.total_return for r in rows if r.symbol == "A")
    assert sweep.sweep_best(frame.where("error IS NOT NULL")).count() == 0


def test_multi_strategy_compare(bars):
    df = bars([10 + i % 5 for i in range(60)], start=datetime(2024, 1, 1))
    rows = explore.multi_strategy_compare(df, [("buy_and_hold", {}), ("sma_cross", {"fast": 2, "slow": 4})]).collect()
    assert {r.strategy for r in rows} == {"buy_and_hold", "sma_cross_2_4"}


def test_a_backtest_over_a_bucketed_table_needs_no_exchange(spark, bars, tmp_path):
    df = bars([float(100 + i % 9) for i in range(80)]).unionByName(bars([50.0] * 80, symbol="B"))
    tables.save_bucketed(df, "bucketed_bars", 4, str(tmp_path / "bars"))
    try:
        stored = spark.table("bucketed_bars")
        stats = bt.backtest_stats(bt.backtest(stored, bt.sma_cross(3, 7)))
        assert "Exchange" not in stats._jdf.queryExecution().executedPlan().toString()
        want = bt.backtest_stats(bt.backtest(df, bt.sma_cross(3, 7)))
        assert sorted(map(repr, stats.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.sql("DROP TABLE bucketed_bars")


def test_axes_grid_is_the_typed_grid(spark, monkeypatch):
    rows = [("sma_cross", "fast", v) for v in (5, 10, 20, 5)] + [("sma_cross", "slow", v) for v in (30, 60)]
    rows += [("sma_cross", "slow", None), ("buy_and_hold", None, None), ("rsi_reversion", "window", None), (None, "fast", 1)]
    axes = spark.createDataFrame(rows, "strategy string, name string, value int")
    typed = sweep.param_grid(spark, "sma_cross", fast=[5, 10, 20], slow=[30, 60])
    typed = typed.unionByName(sweep.param_grid(spark, "buy_and_hold")).unionByName(sweep.param_grid(spark, "rsi_reversion"))
    expected = sorted((r.spec_key, sorted(r.params.items())) for r in typed.collect())
    for block in (4096, 4):
        monkeypatch.setattr(sweep, "GRID_BLOCK", block)
        got = sweep.axes_grid(axes)
        assert sorted((r.spec_key, sorted(r.params.items())) for r in got.collect()) == expected
    assert got.columns == typed.columns
    assert sweep.axes_grid(axes.limit(0)).count() == 0


def test_axes_grid_of_many_specs(spark):
    axes = spark.range(60).selectExpr("'sma_cross' AS strategy", "explode(array('fast', 'slow', 'third')) AS name", "id AS value")
    grid = sweep.axes_grid(axes)
    assert grid.count() == grid.select("spec_key").distinct().count() == 60**3
