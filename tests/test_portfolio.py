from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import filters as fl
from tapeloom.operators import allocation as al
from tapeloom.operators import selection as sel

approx = pytest.approx


@pytest.fixture(scope="module")
def pond(spark):
    rows = [
        ("A", 30e8, 5e6, 0.02, False, 0.10, 0.2),
        ("B", 60e8, 8e6, 0.05, False, 0.05, 0.4),
        ("C", 500e8, 9e7, 0.60, False, 0.20, 0.1),
        ("D", 20e8, 1e6, None, True, None, 0.3),
    ]
    names = "symbol string, float_mktcap double, adv double, inst_ownership double, is_st boolean, momentum double, volatility double"
    return spark.createDataFrame(rows, names)


def symbols(df):
    return sorted(r.symbol for r in df.collect())


def test_filters(pond):
    kept = sel.apply_filters(
        pond, [fl.in_range("float_mktcap", 10e8, 100e8), fl.at_most("inst_ownership", 0.1), fl.flag("is_st", False)]
    )
    assert symbols(kept) == ["A", "B"]


def test_null_drops_and_negation_fills(pond):
    assert symbols(sel.apply_filters(pond, [fl.at_least("momentum", -9)])) == ["A", "B", "C"]
    assert symbols(sel.apply_filters(pond, [fl.negate(fl.at_least("momentum", -9))])) == ["D"]
    assert symbols(sel.apply_filters(pond, [fl.in_range("momentum")])) == ["A", "B", "C", "D"]


def test_rank_divides_by_all_and_leaves_nulls(pond):
    got = {r.symbol: r.score for r in sel.with_score(pond, sel.rank_score("momentum"), by=()).collect()}
    assert got == {"A": 0.5, "B": 0.25, "C": 0.75, "D": None}
    low = {r.symbol: r.score for r in sel.with_score(pond, sel.rank_score("momentum", True), by=()).collect()}
    assert low == {"A": 0.5, "B": 0.75, "C": 0.25, "D": None}


def test_ranks_of_many_values_agree_with_pandas(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=400), rng.integers(-3, 4, 300), rng.lognormal(20, 9, 100), -rng.lognormal(0, 9, 100)])
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(values)], "symbol long, v double")
    import pandas as pd

    for descending in (False, True):
        out = sel.with_average_rank(df.withColumn("g", F.lit(1)), "v", ("g",), "r", descending).toPandas().sort_values("symbol")
        want = pd.Series(values).rank(method="average", ascending=not descending)
        np.testing.assert_allclose(out["r"], want)


def test_top_n_beyond_the_group_limit_of_the_optimizer(spark):
    frame = spark.range(3000).selectExpr("id AS symbol", "CAST(id * 7919 % 3001 AS DOUBLE) AS v")
    got = sel.select_top_n(frame, score=sel.rank_score("v"), top_n=1500, by=()).toPandas().sort_values("position")
    want = sorted((-(i * 7919 % 3001), i) for i in range(3000))[:1500]
    assert list(got["symbol"]) == [i for _, i in want] and list(got["position"]) == list(range(1, 1501))


def test_top_one(pond):
    score = sel.blend([(0.7, sel.rank_score("inst_ownership", ascending=True)), (0.3, sel.rank_score("momentum"))])
    best = sel.select_top_n(pond, [fl.flag("is_st", False)], score, 1, by=())
    assert symbols(best) == ["A"]
    assert sel.select_top_n(pond, [fl.at_least("adv", 1e99)], score, 1, by=()).count() == 0


def test_features_exclude_the_asof_bar(bars):
    df = bars([10, 11, 12, 13])
    row = sel.build_features(df, datetime(2024, 1, 3), 60).first()
    assert (row.price, row.bars, row.momentum) == (11, 2, approx(0.1))
    assert sel.build_features(df, datetime(2020, 1, 1)).count() == 0
    assert sel.build_features(df, lookback=2).first().momentum == approx(13 / 12 - 1)


def test_weights(pond):
    picks = pond.where("symbol <> 'D'").withColumn("asof", F.lit(1))
    equal = {r.symbol: r.weight for r in al.equal_weight(picks, 0.9, 0.5).collect()}
    assert equal == approx({"A": 0.3, "B": 0.3, "C": 0.3})
    assert {r.weight for r in al.equal_weight(picks).collect()} == {0.2}
    inverse = {r.symbol: r.weight for r in al.inverse_vol(picks, gross=1.0, max_weight=1.0).collect()}
    assert inverse["C"] == approx(10 / 17.5) and sum(inverse.values()) == approx(1)
    score = al.score_proportional(picks.withColumn("score", F.col("momentum") - 0.05), gross=1.0, max_weight=1.0)
    assert {r.symbol: r.weight for r in score.collect()} == approx({"A": 0.25, "C": 0.75})


@pytest.fixture(scope="module")
def switch(bars):
    rise = [100 + i for i in range(50)] + [150 - i for i in range(50)]
    flat = [100] * 50 + [100 + i for i in range(50)]
    return bars(rise, "A").unionByName(bars(flat, "B"))


def test_schedule_switches(switch):
    dates, weights = al.periodic_schedule(switch, score=sel.rank_score("momentum"), top_n=1, every=20, lookback=20)
    chosen = {r.asof: r.symbol for r in weights.collect()}
    assert dates.count() == 4 and sorted(chosen) == sorted(r.asof for r in dates.collect())
    assert [chosen[d] for d in sorted(chosen)] == ["A", "A", "B", "B"]


def test_features_asof_agrees_with_one_date_at_a_time(switch, spark):
    days = [date(2024, 1, 5), date(2024, 2, 10), date(2024, 4, 30), date(2024, 5, 20)]
    sparse = switch.where("symbol = 'A' OR dayofmonth(timestamp) < 8")
    dates = spark.createDataFrame([(d,) for d in days], "asof date")
    got = {(r.asof, r.symbol): r for r in al.features_asof(sparse, dates, 30).collect()}
    want = {}
    for day in days:
        for row in sel.build_features(sparse, datetime(day.year, day.month, day.day), 30).collect():
            want[day, row.symbol] = row
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name in sel.FEATURES:
            assert got[key][name] == (None if row[name] is None else approx(row[name])), (key, name)


def test_budget_in_force(switch, spark):
    dates = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 2, 1),)], "asof date")
    weights = spark.createDataFrame([(date(2024, 1, 10), "A", 0.2)], "asof date, symbol string, weight double")
    out = {(r.symbol, r.timestamp): r.budget for r in al.active_budget(switch, dates, weights).collect()}
    assert out["A", datetime(2024, 1, 9)] == 0 and out["A", datetime(2024, 1, 10)] == 0.2
    assert out["A", datetime(2024, 1, 31)] == 0.2 and out["A", datetime(2024, 2, 1)] == 0
    assert out["B", datetime(2024, 1, 15)] == 0
    assert {r.budget for r in al.static_budget(switch).collect()} == {1.0}


def test_ranks_of_close_and_common_values_are_spread(spark):
    """Half of the rows hold one value, the others differ by less than a millionth of it."""
    frame = spark.range(6000).selectExpr("id AS symbol", "'g' AS g", "CASE WHEN id % 2 = 0 THEN 100.0D WHEN id % 7 = 1 THEN NULL ELSE 100.0D + (id % 1999) * 1e-9 END AS v")
    for descending in (False, True):
        out = sel.with_average_rank(frame, "v", ("g",), "r", descending, cuts=13).toPandas().sort_values("symbol")
        want = out["v"].rank(method="average", ascending=not descending)
        np.testing.assert_allclose(out["r"].astype(float), want)
