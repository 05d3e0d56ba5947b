from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.codes import from_exchange_code, limit_pct, to_exchange_code
from tapeloom.operators.resample import resample
from tapeloom.sources import ingest, tables

approx = pytest.approx


@pytest.fixture(scope="module")
def minute_day(spark):
    rows = []
    for i in range(240):
        start = datetime(2024, 1, 2, 1, 30) if i < 120 else datetime(2024, 1, 2, 3, 0)
        price = 100 + 0.1 * i + (0 if i < 120 else 0)
        rows.append(("A", "1m", start + timedelta(minutes=i), price, price + 0.5, price - 0.5, price + 0.05, 100 + i))
    from tapeloom.schema import BAR_SCHEMA

    return spark.createDataFrame(rows, BAR_SCHEMA)


@pytest.mark.parametrize(("target", "n"), [("5m", 48), ("15m", 16), ("30m", 8), ("1h", 4), ("1d", 1)])
def test_resample_counts_and_volume(minute_day, target, n):
    out = resample(minute_day, target).collect()
    assert len(out) == n and {r.interval for r in out} == {target}
    assert sum(r.volume for r in out) == sum(100 + i for i in range(240))


def test_hour_bars_never_cross_lunch(minute_day, column):
    stamps = column(resample(minute_day, "1h"), "timestamp")
    assert [(t.hour, t.minute) for t in stamps] == [(1, 30), (2, 30), (5, 0), (6, 0)]


def test_first_five_minute_bar(minute_day):
    bar = resample(minute_day, "5m").orderBy("timestamp").first()
    got = (bar.open, bar.high, bar.low, bar.close, bar.volume)
    assert got == approx((100.0, 100.9, 99.5, 100.45, 510))


def test_daily_bar(minute_day):
    bar = resample(minute_day, "1d").first()
    assert bar.close == approx(123.95) and bar.timestamp == datetime(2024, 1, 2)


def test_resample_to_finer_is_refused(minute_day):
    with pytest.raises(ValueError, match="finer"):
        resample(minute_day, "1m", "5m")
    assert resample(minute_day, "1m").count() == 240


def test_table_round_trip(spark, bars):
    tables.create_bars_table(spark, "bars_rt")
    tables.create_bars_table(spark, "bars_rt")
    assert tables.write_bars(bars([1, 2, 3], "A"), "bars_rt") == 3
    assert tables.write_bars(bars([5, 6], "A", start=datetime(2024, 1, 3)), "bars_rt") == 2
    stored = spark.table("bars_rt")
    got = tables.read_bars(stored, ["A"], "1d", dedup=True)
    assert [r.close for r in got.collect()] == [1, 2, 5, 6]
    cut = tables.read_bars(stored, ["A"], "1d", datetime(2024, 1, 2), datetime(2024, 1, 3), dedup=True)
    assert [r.close for r in cut.collect()] == [2]
    plan = cut._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "month" in plan
    assert tables.latest_timestamps(stored).first().latest == datetime(2024, 1, 4)
    assert [r.symbol for r in tables.list_symbols(stored, "1d").collect()] == ["A"]
    assert tables.list_symbols(stored, "1m").count() == 0
    with pytest.raises(ValueError, match="volume"):
        tables.write_bars(bars([1]).drop("volume"), "bars_rt")


def test_dedup_is_idempotent(bars):
    first = bars([1, 2]).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    later = bars([7, 8]).withColumn("ingested_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    once = tables.dedup_bars(first.unionByName(later))
    assert sorted(r.close for r in once.collect()) == [7, 8]
    assert tables.dedup_bars(once).exceptAll(once).count() == 0


def test_validation_reasons(bars):
    df = bars([(10, 11, 9, 10, 5), (10, 9, 11, 10, 5), (12, 11, 9, 10, 5), (10, 11, 9, 8, 5), (10, 11, 9, 10, -1)])
    good, bad = ingest.validate_bars(df)
    assert good.count() == 1
    assert {r.reason for r in bad.collect()} == {
        "high below low",
        "open outside range",
        "close outside range",
        "negative volume",
    }
    assert ingest.skip_report(bad).first().skipped == 4


def test_vendor_rows(spark):
    rows = [
        ("A", "2024-01-02", "10", "11", "9", "10.5", "12.345"),
        ("A", "2024-01-03 00:00", "10", "11", "9", "10.5", "1"),
        ("A", "not a day", "10", "11", "9", "10.5", "1"),
        ("A", "2024-01-05", "x", "11", "9", "10.5", "1"),
        ("A", "2024-01-06", "nan", "11", "9", "10.5", "1"),
        ("A", "2024-01-07", "10", "11", "9", "10.5", "nan"),
    ]
    raw = spark.createDataFrame(rows, ["symbol", *ingest.VENDOR_COLUMNS.values()])
    got = ingest.normalize_daily(raw).orderBy("timestamp").collect()
    assert [r.volume for r in got] == [1234, 100]
    assert ingest.skip_report(ingest.parse_daily(raw).where("reason IS NOT NULL")).first().skipped == 4
    epoch = spark.createDataFrame([("A", "20240102", 1704159000123, 1.0, 1.0, 1.0, 1.0, 2.5)], "symbol string, label string, time long, open double, high double, low double, close double, volume double")
    assert ingest.normalize_epoch(epoch, "1m").first().timestamp == datetime(2024, 1, 2, 1, 30, 0, 123000)
    assert ingest.normalize_epoch(epoch, "1d").first().timestamp == datetime(2024, 1, 2)
    assert ingest.normalize_epoch(epoch, "1d").first().volume == 2


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("600519", "600519.SH"), ("000001", "000001.SZ"), ("300750", "300750.SZ"), ("688981", "688981.SH"),
        ("830799", "830799.BJ"), ("430047", "430047.BJ"), ("920819", "920819.SH"), ("600519.sh", "600519.SH"),
        (" 000001 ", "000001.SZ"), ("5X", "5X.SH"),
    ],
)
def test_exchange_codes(spark, code, want):
    row = spark.range(1).select(to_exchange_code(F.lit(code)).alias("c")).first()
    assert row.c == want
    assert spark.range(1).select(from_exchange_code(F.lit(want)).alias("c")).first().c == want.split(".")[0]


@pytest.mark.parametrize(
    ("code", "pct"),
    [("600519", 0.1), ("688981", 0.2), ("300750", 0.2), ("830799", 0.3), ("430047", 0.3), ("920819", 0.3),
     ("900901", 0.1), ("FAKE001", 0.1), ("30", 0.1), ("688981.SH", 0.2)],
)
def test_limit_pct(spark, code, pct):
    assert spark.range(1).select(limit_pct(F.lit(code)).alias("p")).first().p == pct


def test_universe_picks_the_first_non_empty(spark):
    raw = spark.createDataFrame(
        [("A ", "x", "B", "y"), ("", "", "C", " z "), ("  ", "q", "D", "w"), (None, None, None, "v")],
        ["code", "name", "代码", "名称"],
    )
    assert {tuple(r) for r in ingest.normalize_universe(raw).collect()} == {("A", "x"), ("C", "z")}


def test_sync_plan_and_upsert(spark, bars):
    stored = bars([1, 2, 3, 4, 5, 6, 7, 8], "A").unionByName(bars([1, 2], "B"))
    universe = spark.createDataFrame([("A",), ("B",), ("C",)], ["symbol"])
    latest = tables.latest_timestamps(stored)
    plan = ingest.sync_plan(universe, latest, datetime(1990, 1, 1))
    starts = {r.symbol: r.start for r in plan.collect()}
    assert starts == {"A": datetime(2024, 1, 3), "B": datetime(2023, 12, 28), "C": datetime(1990, 1, 1)}
    forced = ingest.sync_plan(universe, latest, datetime(1990, 1, 1), force=True)
    assert {r.start for r in forced.collect()} == {datetime(1990, 1, 1)}
    fetched = bars(range(1, 11), "A").unionByName(bars([1, 2], "B")).unionByName(bars([3], "C"))
    rows = ingest.incremental_upsert(fetched, plan)
    counts = {r.symbol: r["count"] for r in rows.groupBy("symbol").count().collect()}
    assert counts == {"A": 8, "C": 1}
    errors = spark.createDataFrame([("B", "timeout")], ["symbol", "error"])
    report = ingest.backfill_report(universe, rows, errors).first()
    assert (report.total, report.synced, report.skipped, report.failed, report.rows) == (3, 2, 0, 1, 9)


def test_artifacts(spark, bars, tmp_path):
    frame = bars([1, 2]).withColumn("spec_key", F.lit("k1"))
    tables.write_artifacts(frame, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where("spec_key = 'k1'").count() == 2
