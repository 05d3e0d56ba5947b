from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind
from tapeloom.operators import summary
from tapeloom.operators.series import Series, _placed, _shared, _with_shared, lay_out, running

approx = pytest.approx
BLOCKS = Series(step="1m", cuts=23)


def one(df, indicator, column):
    return column(ind.with_indicators(df, [indicator.named("x")]), "x")


def test_sma_needs_a_full_window(bars, column):
    assert one(bars([1, 2, 3, 4, 5]), ind.sma(window=2), column) == [None, 1.5, 2.5, 3.5, 4.5]


def test_returns(bars, column):
    got = one(bars([10, 11, 22]), ind.simple_return(), column)
    assert got[0] is None and got[1:] == approx([0.1, 1.0])


def test_ema_starts_with_the_first_value(bars, column):
    got = one(bars([10, 20, 30]), ind.ema(span=3), column)
    assert got == approx([10, 15, 22.5])


def test_rsi_of_gains_only_is_100(bars, column):
    got = one(bars(range(1, 40)), ind.rsi(), column)
    assert math.isnan(got[0]) and got[-1] == 100


def test_drawdown(bars, column):
    assert min(one(bars([10, 12, 9, 11]), ind.drawdown(), column)) == approx(9 / 12 - 1)


def test_first_true_range_is_high_less_low(bars, column):
    assert one(bars([10, 12]), ind.true_range(), column) == [2.0, 3.0]


def test_cci_warm_up_is_double(bars, column):
    got = one(bars([float(i % 5) + 10 for i in range(12)]), ind.cci(window=4), column)
    assert got[:6] == [None] * 6 and got[6] is not None


def test_stochastic_and_williams_bounds(bars, column):
    df = bars([10 + math.sin(i) for i in range(30)])
    out = ind.with_indicators(df, [ind.stochastic_oscillator(), ind.williams_r()])
    assert all(v is None or 0 <= v <= 100 for v in column(out, "stochastic_percent_k"))
    assert all(v is None or -100 <= v <= 0 for v in column(out, "williams_r"))


def test_obv_and_vwap(bars, column):
    df = bars([(1, 1, 1, 1, 10), (2, 2, 2, 2, 20), (2, 2, 2, 2, 30), (1, 1, 1, 1, 40)])
    assert one(df, ind.obv(), column) == [0, 20, 20, -20]
    assert one(df, ind.vwap(), column)[1] == approx(50 / 30)


def test_unknown_metric_lists_the_known(bars):
    with pytest.raises(ValueError, match="sma"):
        ind.metric_panel(bars([1, 2]), [("nope", {}, "x")])


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("HOT", 3000), ("B", 400), ("C", 3)):
        close = 50 + np.cumsum(rng.normal(size=n)) * 0.1
        stamp = pd.date_range("2024-01-01", periods=n, freq="min")
        gap = stamp + pd.to_timedelta((np.arange(n) // 100) * 600, unit="min")
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "interval": "1m",
                    "timestamp": gap,
                    "open": close,
                    "high": close + rng.random(n),
                    "low": close - rng.random(n),
                    "close": close,
                    "volume": rng.integers(1, 99, n),
                }
            )
        )
    data = pd.concat(frames, ignore_index=True)
    from tapeloom.schema import BAR_SCHEMA

    return spark.createDataFrame(data, BAR_SCHEMA)


def test_blocks_agree_with_plain_windows(walk):
    """The hot series spans many blocks; every metric must be what one window gives."""
    panel = [(name, {}, name) for name in ind.REGISTRY]
    frames = []
    for series in (Series(), BLOCKS):
        out = ind.metric_panel(walk, panel, series).toPandas()
        frames.append(out.sort_values(["symbol", "timestamp"]).reset_index(drop=True))
    plain, cut = frames
    assert list(plain.columns) == list(cut.columns)
    for name in plain.columns.drop(["symbol", "interval", "timestamp"]):
        a, b = plain[name].to_numpy(dtype=float), cut[name].to_numpy(dtype=float)
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, err_msg=name)


def test_ewm_agrees_with_pandas(walk):
    out = ind.metric_panel(walk, [("ema", {"span": 30}, "e")], BLOCKS).toPandas()
    for _, group in out.sort_values("timestamp").groupby("symbol"):
        want = group["close"].ewm(span=30, adjust=False).mean()
        np.testing.assert_allclose(group["e"], want, rtol=1e-10)


def test_no_lookahead(walk):
    cut = walk.where("timestamp < TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    panel = [("sma", {}, "s"), ("rsi", {}, "r"), ("obv", {}, "o")]
    full = ind.metric_panel(walk, panel, BLOCKS).toPandas()
    part = ind.metric_panel(cut, panel, BLOCKS).toPandas()
    both = part.merge(full, on=["symbol", "timestamp"])
    assert len(both) == len(part)
    for name in "sro":
        np.testing.assert_allclose(both[f"{name}_x"], both[f"{name}_y"], rtol=1e-9)


def test_summary_numbers(bars):
    row = summary.summary_by_symbol(bars([100, 110, 99, 121])).first()
    assert row.total_return == approx(0.21) and row.max_drawdown == approx(-0.1)
    assert row.calmar_ratio == approx(row.cagr / 0.1)


def test_sortino_counts_the_first_bar(bars):
    row = summary.sortino_ratio(bars([100, 90, 99])).first()
    assert row.sortino_ratio == approx(0.0 / 1) or abs(row.sortino_ratio) < 1e-9


def test_summary_of_one_bar(bars):
    row = summary.summary_by_symbol(bars([100])).first()
    assert row.total_return == 0 and row.cagr is None and row.sharpe_ratio is None


def test_summary_in_blocks(walk):
    plain = summary.summary_by_symbol(walk).toPandas().sort_values("symbol")
    cut = summary.summary_by_symbol(walk, series=BLOCKS).toPandas().sort_values("symbol")
    for name in summary.ALL_METRICS:
        np.testing.assert_allclose(plain[name], cut[name], rtol=1e-8, err_msg=name)


def test_rsi_of_a_long_flat_stretch_is_the_same_in_blocks(spark):
    """The averages decay to the end of the range of a double, but their ratio stays."""
    n = 9600
    close = 50 + np.concatenate([np.cumsum(np.random.default_rng(3).normal(size=50)), np.zeros(n - 50)])
    close[50:] = close[49]
    stamp = pd.date_range("2024-01-01", periods=n, freq="min")
    frame = pd.DataFrame({"symbol": "A", "timestamp": stamp, "close": close})
    df = spark.createDataFrame(frame).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    gain = pd.Series(close).diff().clip(lower=0).fillna(0.0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-pd.Series(close).diff().clip(upper=0)).fillna(0.0).ewm(alpha=1 / 14, adjust=False).mean()
    want = (100 - 100 / (1 + gain / loss)).to_numpy()
    for series in (Series(), Series(step="1m", cuts=3), Series(step="1m", cuts=60)):
        got = ind.with_indicators(df, [ind.rsi().named("x")], series).toPandas().sort_values("timestamp")["x"]
        np.testing.assert_allclose(got.to_numpy()[1:], want[1:], rtol=1e-6)


def fills_of(spark, n, key="'A'"):
    return spark.range(n).selectExpr(f"{key} AS symbol", "timestampadd(SECOND, CAST(id div 3 AS INT), TIMESTAMP_NTZ '2024-01-02') AS timestamp", "id AS seq", "id % 7 AS x")


def test_passes_over_a_cut_series_share_one_exchange(spark):
    series = Series(order=("timestamp", "seq"), step=None, cuts=9)
    lay = running(lay_out(fills_of(spark, 4000), series, 5), {"total": ("sum", F.col("x"))})
    lay = running(lay, {"most": ("max", F.col("total"))})
    rows = lay.df.orderBy("seq").select("total", "most")
    got = [tuple(r) for r in rows.collect()]
    sums = np.cumsum([i % 7 for i in range(4000)]).tolist()
    assert got == list(zip(sums, sums))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Range (") == 1 and "ReusedExchange" in plan


def test_a_cut_series_keeps_null_keys_and_keys_in_one_block(spark):
    key = "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 100 = 1 THEN CAST(id AS STRING) ELSE 'A' END"
    series = Series(order=("timestamp", "seq"), step=None)
    for cuts in (1, 7):
        lay = running(lay_out(fills_of(spark, 3000, key), replace(series, cuts=cuts)), {"nth": ("sum", F.lit(1))})
        ends = {r.symbol: (r.n, r.m) for r in lay.df.groupBy("symbol").agg(F.count("*").alias("n"), F.max("nth").alias("m")).collect()}
        assert len(ends) == 32 and all(n == m for n, m in ends.values()) and ends[None] == (600, 600)


def test_passes_that_were_cut_elsewhere_fail(spark):
    series = Series(order=("timestamp", "seq"), step=None, cuts=5)
    rows = _placed(fills_of(spark, 2000), series)
    other = _placed(fills_of(spark, 2000).where("seq < 1500"), series)
    with pytest.raises(Exception, match="cut at different rows"):
        _with_shared(rows, series, _shared(other, series, F.sum("x").alias("s")), ["s"]).agg(F.sum("s")).collect()


@pytest.mark.parametrize("window", [3, 65, 200])
@pytest.mark.parametrize("cuts", [None, 11])
def test_rolling_extremes_agree_with_a_sliding_frame(spark, bars, window, cuts):
    rng = np.random.default_rng(window)
    close = (100 + rng.normal(size=700).cumsum()).tolist()
    rows = [(c, c + rng.random(), c - rng.random(), c, 1) for c in close]
    df = bars(rows).unionByName(bars(rows[:window], symbol="B"))
    df = df.withColumn("high", F.when(F.dayofyear("timestamp") != 90, F.col("high")))
    out = ind.with_indicators(df, [ind.williams_r(window), ind.stochastic_oscillator(window)], Series(cuts=cuts)).toPandas()
    for _, part in out.groupby("symbol"):
        part = part.sort_values("timestamp")
        top, low = part["high"].rolling(window).max(), part["low"].rolling(window).min()
        want = -100 * (top - part["close"]) / (top - low)
        np.testing.assert_allclose(part["williams_r"].astype(float), want, rtol=1e-9)
        np.testing.assert_allclose(part["stochastic_percent_k"].astype(float), want + 100, rtol=1e-9, atol=1e-9)
