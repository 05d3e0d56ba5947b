from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import backtest as bt
from tapeloom.operators import ledger, market, orders, series
from tapeloom.operators.series import Series, lay_out, running
from tapeloom.streaming import jobs

approx = pytest.approx
FILL = "account long, timestamp timestamp_ntz, seq long, symbol string, side string, shares long, price double, reason string"
DAY = datetime(2024, 1, 1)


def fill_rows(spark, *rows):
    data = [(1, DAY + timedelta(days=d), i, s, side, n, float(p), "x") for i, (d, s, side, n, p) in enumerate(rows)]
    return spark.createDataFrame(data, FILL)


def test_position_ledger(spark, column):
    fills = fill_rows(
        spark, (0, "A", "buy", 100, 10), (1, "A", "buy", 100, 20), (2, "A", "sell", 50, 30), (3, "A", "sell", 150, 30), (4, "A", "buy", 100, 7)
    )
    out = ledger.position_ledger(fills)
    assert column(out, "held", "seq") == [100, 200, 150, 0, 100]
    assert column(out, "avg_price", "seq") == [approx(10), approx(15), approx(15), None, approx(7)]
    assert [(r.shares, r.avg_price) for r in ledger.holdings_of(out).collect()] == [(100, approx(7))]


def test_ledgers_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows, held = [], 0
    for i in range(700):
        sell = held > 0 and rng.random() < 0.5
        n = int(rng.integers(1, held + 1)) if sell else int(rng.integers(1, 9))
        held += -n if sell else n
        rows.append((i // 5, "A", "sell" if sell else "buy", n, 10 + rng.random()))
    fills = ledger.fills_enriched(fill_rows(spark, *rows))
    for keys, run in ((("account", "symbol"), ledger.position_ledger), (("account",), lambda f, s: ledger.cash_ledger(f, 1e6, s))):
        plain = run(fills, Series(keys, ledger.ORDER)).toPandas().sort_values("seq")
        cut = run(fills, Series(keys, ledger.ORDER, None, 35)).toPandas().sort_values("seq")
        for name in plain.columns.difference(["timestamp", "symbol", "side", "reason"]):
            np.testing.assert_allclose(plain[name].astype(float), cut[name].astype(float), rtol=1e-9, err_msg=name)


def test_a_day_of_one_account_is_cut_into_blocks(spark):
    """Whether its fills share one time or not, a block holds about its share of them."""
    fills = spark.range(40_000).selectExpr(
        "1 AS account", "'A' AS symbol", "id AS seq",
        "timestampadd(MICROSECOND, IF(id < 30000, 0, CAST(id AS INT)), TIMESTAMP_NTZ '2024-01-02 10:00:00') AS timestamp",
    )
    lay = lay_out(fills, replace(ledger.ACCOUNT, cuts=40))
    sizes = [r["count"] for r in lay.df.groupBy(*lay.parts).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2000 and len(sizes) >= 20


def test_a_task_of_a_ledger_holds_one_block(spark):
    """Neither adaptive execution nor a hash puts several blocks into one task."""
    fills = spark.range(40_000).selectExpr(
        "1 AS account", "'A' AS symbol", "id AS seq", "IF(id % 2 = 0, 'buy', 'sell') AS side", "CAST(9 AS BIGINT) AS shares",
        "10D AS price", "1D AS cost", "90D AS notional", "timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-02') AS timestamp",
    )
    deep = running(lay_out(fills, replace(ledger.ACCOUNT, cuts=40), 5), {"total": ("sum", F.col("shares"))}).df
    cut = ledger.position_ledger(fills, replace(ledger.POSITION, cuts=40))
    cash = ledger.cash_ledger(fills, 1e6, replace(ledger.ACCOUNT, cuts=40))
    for out, name in ((cut, "avg_price"), (cash, "cash"), (deep, "total")):
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(name))
        sizes = [r.n for r in tasks.collect()]
        assert sum(sizes) == 40_000 and max(sizes) <= 2000 and len(sizes) >= 20


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A task of a ledger holds no more rows for a larger input, at the same shuffle partitions."""
    monkeypatch.setattr(series, "ROWS_PER_RANGE", 1000, raising=False)
    fills = spark.range(30_000).selectExpr(
        "1 AS account", "'A' AS symbol", "id AS seq", "IF(id % 2 = 0, 'buy', 'sell') AS side", "CAST(9 AS BIGINT) AS shares",
        "10D AS price", "timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-02') AS timestamp",
    )
    rows = ledger.position_ledger(fills)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max("avg_price"))
    sizes = [r.n for r in tasks.collect()]
    assert sum(sizes) == 30_000 and max(sizes) <= 2000
    assert rows.agg(F.sum("held")).first()[0] == 15_000 * 9


def test_average_price_by_hand_over_many_sells(spark):
    rows, held, avg, want = [], 0, 0.0, []
    for i in range(400):
        if i % 3 == 2:
            n = max(1, held * 9 // 10)
            rows.append((i, "A", "sell", n, 1))
            held -= n
        else:
            rows.append((i, "A", "buy", 50, 10 + i % 7))
            avg = (avg * held + 50 * (10 + i % 7)) / (held + 50)
            held += 50
        want.append(avg)
    got = ledger.position_ledger(fill_rows(spark, *rows)).orderBy("seq").collect()
    assert [r.avg_price for r in got] == approx(want)


def test_marks_and_equity(spark, bars, column):
    df = bars([10, 11, 12, 13], "A").unionByName(bars([5, 6], "B", start=DAY + timedelta(days=2)))
    fills = ledger.fills_enriched(fill_rows(spark, (1, "A", "buy", 100, 11), (1, "B", "buy", 100, 4), (3, "A", "sell", 100, 13)))
    marks = ledger.mark_to_market(ledger.position_ledger(fills), df)
    got = {(r.symbol, r.timestamp.day): r.price for r in marks.collect()}
    assert got == {("A", 2): 11, ("A", 3): 12, ("B", 2): 4, ("B", 3): 5, ("B", 4): 6}
    cash = ledger.cash_ledger(fills, 10_000)
    curve = ledger.equity_curve(cash, marks, df, 10_000)
    assert column(curve, "cash", "timestamp")[0] == 10_000
    last = curve.orderBy(F.desc("timestamp")).first()
    assert last.equity == approx(last.cash + 600)


def test_limit_band_and_suspension(bars):
    df = bars([(10, 10, 10, 10, 5), (11, 11, 11, 11, 5), (9.9, 9.9, 9.9, 9.9, 5), (10, 10, 10, 10, 0)], "600519")
    rows = market.limit_band(df).orderBy("timestamp").collect()
    assert [r.buy_blocked for r in rows] == [False, True, False, True]
    assert [r.sell_blocked for r in rows] == [False, False, True, True]
    relaxed = market.MarketRules(price_limits=False, suspension=False)
    assert not any(r.buy_blocked or r.sell_blocked for r in market.limit_band(df, relaxed).collect())


def test_sizes(spark):
    row = spark.range(1).select(
        market.volume_cap(F.lit(2550.0)).alias("cap"),
        market.volume_cap(F.lit(2550.0), 0).alias("off"),
        market.target_shares(F.lit(0.2), F.lit(1e6), F.lit(9.99)).alias("near"),
        market.target_shares(F.lit(0.0), F.lit(1e6), F.lit(9.99)).alias("none"),
        market.participation(F.lit(100), F.lit(0)).alias("dry"),
    ).first()
    assert (row.cap, row.off, row.near, row.none, row.dry) == (200, None, 20000, 0, 0)


@pytest.mark.parametrize("span", ["month", "day"])
def test_stop_scan(spark, bars, span):
    df = bars([(100, 101, 99, 100, 5), (100, 101, 90, 99, 5), (85, 86, 84, 85, 5), (80, 81, 79, 80, 5)], "A")
    entries = spark.createDataFrame(
        [("A", DAY, 100.0), ("A", DAY + timedelta(days=1), 100.0), ("A", DAY, 50.0), ("Z", DAY, 1.0)],
        "symbol string, entry_ts timestamp_ntz, entry_price double",
    )
    got = {(r.symbol, r.entry_ts.day, r.entry_price): (r.exit_ts and r.exit_ts.day, r.exit_price) for r in market.stop_exit_scan(entries, df, 0.08, span).collect()}
    assert got["A", 1, 100.0] == (2, approx(92)) and got["A", 2, 100.0] == (3, 85)
    assert got["A", 1, 50.0] == (None, None) and got["Z", 1, 1.0] == (None, None)


def test_t1(spark, bars):
    holdings = spark.createDataFrame([(1, "A", 500, 10.0)], "account long, symbol string, shares long, avg_price double")
    fills = fill_rows(spark, (0, "A", "buy", 200, 10))
    bar = bars([(10, 10, 10, 10, 100000)], "A")
    assert market.t1_sellable(holdings, fills, bar).first().sellable == 300
    free = market.MarketRules(t_plus_1=False, participation_rate=0)
    assert market.t1_sellable(holdings, fills, bar, free).first().sellable == 500


def test_daily_halt_latches(spark):
    values = [100, 94, 99, 99, 95, 93]
    stamps = [DAY + timedelta(hours=h) for h in (1, 2, 3, 25, 26, 27)]
    df = spark.createDataFrame([(1, t, float(v)) for t, v in zip(stamps, values)], "account long, timestamp timestamp_ntz, equity double")
    rows = market.daily_loss_halt(df).orderBy("timestamp").collect()
    assert [r.halted for r in rows] == [False, True, True, False, False, True]
    assert [r.day_start for r in rows] == [100] * 3 + [99] * 3


def test_order_cap_and_lots(spark):
    fills = fill_rows(spark, (0, "A", "buy", 100, 1), (0, "B", "buy", 150, 1), (0, "C", "buy", 100, 1), (0, "D", "sell", 100, 1))
    assert [r.allowed for r in orders.order_cap(fills, 2).orderBy("seq").collect()] == [True, True, False, True]
    assert orders.lot_check(fills).count() == 3


@pytest.fixture(scope="module")
def account(spark):
    return spark.createDataFrame([(1, 100_000.0, 100_000.0)], "account long, cash double, day_start_equity double")


def held(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "account long, symbol string, shares long, avg_price double")


def test_order_sheet(spark, bars, account):
    df = bars([10] * 40, "A").unionByName(bars([10] * 40, "B")).unionByName(bars([9] * 40, "C"))
    holdings = held(spark, ("B", 100, 20.0), ("C", 100, 9.0))
    names = spark.createDataFrame([(1, n) for n in "ABC"], "account long, symbol string")
    rows = orders.order_sheet(df, bt.buy_and_hold(), names, holdings, account).orderBy("nth").collect()
    assert [(r.symbol, r.side, r.shares, r.reason) for r in rows] == [
        ("B", "sell", 100, "stop_loss"),
        ("A", "buy", 2000, "signal"),
    ]
    flat = bt.sma_cross(2, 3)
    rows = orders.order_sheet(df, flat, names, holdings, account).orderBy("nth").collect()
    assert [(r.symbol, r.reason) for r in rows] == [("B", "stop_loss"), ("C", "signal_exit")]
    ruined = account.withColumn("day_start_equity", F.lit(1e9))
    rows = orders.order_sheet(df, bt.buy_and_hold(), names, holdings, ruined).collect()
    assert [r.reason for r in rows] == ["stop_loss"]
    none = orders.order_sheet(df, bt.buy_and_hold(), names.limit(0), holdings, account).collect()
    assert [r.reason for r in none] == ["stop_loss"]


def test_order_delta_scales_in_and_out(spark, bars):
    df = market.limit_band(bars([(10, 10, 10, 10, 10**7)], "A").unionByName(bars([(10, 10, 10, 10, 10**7)], "B")))
    rows = df.withColumns({"account": F.lit(1).cast("long"), "signal": F.when(F.col("symbol") == "A", 0.1).otherwise(0.0), "budget": F.lit(1.0)})
    accounts = spark.createDataFrame([(1, 50_000.0, 100_000.0)], "account long, cash double, equity double")
    out = {r.symbol: (r.side, r.shares) for r in orders.order_delta(rows, held(spark, ("B", 300, 10.0)), accounts).collect()}
    assert out == {"A": ("buy", 1000), "B": ("sell", 300)}
    halted = accounts.withColumn("halted", F.lit(True))
    out = {r.symbol for r in orders.order_delta(rows, held(spark, ("B", 300, 10.0)), halted).collect()}
    assert out == {"B"}


def test_scan_sees_bars_of_any_age(spark, bars, account, tmp_path):
    # A is traded throughout, B and C were suspended long ago, D has few bars, spread over years.
    day, long_ago = DAY + timedelta(days=1500), timedelta(days=400)
    df = bars([10] * 90, "A", start=day).unionByName(bars([10] * 40, "B")).unionByName(bars(list(range(9, 49)), "C"))
    df = df.unionByName(bars([9, 10, 11, 12, 30], "D", start=day - 3 * long_ago, step=long_ago))
    holdings = held(spark, ("B", 100, 20.0), ("D", 300, 15.0))
    names = spark.createDataFrame([(1, n) for n in "ACD"], "account long, symbol string")
    source = str(tmp_path / "landing")
    stored = df.withColumn("ingested_at", F.col("timestamp"))
    stored.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(stored.schema).parquet(source)
    out, signal = str(tmp_path / "sheets"), bt.sma_cross(2, 4)
    jobs.stream_scan(
        stream, str(tmp_path / "table"), signal, names, holdings, account, out, str(tmp_path / "cp"), lookback=20, history_days=60
    ).awaitTermination()
    columns = ["account", "nth", "symbol", "side", "shares", "price", "reason"]
    got = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    whole = sorted(map(tuple, orders.order_sheet(df, signal, names, holdings, account, lookback=20).select(columns).collect()))
    assert got == whole and [(r[2], r[6]) for r in got] == [("B", "stop_loss"), ("C", "signal")]
