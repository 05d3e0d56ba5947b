"""Checks of selection, allocation and rebalancing."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.registry import add, view
from checks.strategies import SMA_TARGET, backtest_sql
from tapeloom.functions import filters as fl
from tapeloom.operators import allocation as al
from tapeloom.operators import backtest as bt
from tapeloom.operators import selection as sel
from tapeloom.session import settle
from tapeloom.sources import views

ASOF = datetime(2000, 6, 1)
FEATURES = "price:4 adv:1 volatility:6 momentum:6 bars"
CTX = "float_mktcap:0 inst_ownership:4 is_st"


def features_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, arg_max(close, timestamp) AS price, avg(close * volume) AS adv,
    stddev_samp(r) * sqrt(252e0) AS volatility,
    arg_max(close, timestamp) / arg_min(close, timestamp) - 1 AS momentum, count(*) AS bars
    FROM (SELECT *, close / lag(close) OVER (PARTITION BY {keys} ORDER BY timestamp) - 1 AS r FROM ({source}) s) t
    GROUP BY {keys}"""


NEWEST = """SELECT * FROM bars_daily WHERE timestamp < TIMESTAMP '2000-06-01'
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) <= 60"""
view("features", features_sql(NEWEST, "symbol"))
add(
    "build_features",
    f"symbol {FEATURES}",
    lambda s, d: sel.build_features(views.bars_daily(s, d), ASOF, 60),
    "SELECT * FROM features",
)
view(
    "fundamentals",
    """SELECT list_extract(['600519', '000001', '300750', '688981', '830799', '920819', '002594', '601318', '430047'],
    CAST(s_suppkey % 10 AS INTEGER) + 1) AS symbol, sum(s_acctbal) * 1000000e0 AS float_mktcap,
  (s_suppkey % 10) / 20e0 AS inst_ownership, s_suppkey % 10 = 8 AS is_st
  FROM supplier WHERE s_suppkey % 10 < 9 GROUP BY s_suppkey % 10""",
)
view("crossed", "SELECT * FROM features LEFT JOIN fundamentals USING (symbol)")


def cross(s, d):
    return sel.build_features(views.bars_daily(s, d), ASOF, 60, views.fundamentals(s, d))


add(
    "join_fundamentals",
    f"symbol {FEATURES} {CTX}",
    lambda s, d: cross(s, d).withColumn("is_st", F.col("is_st").cast("string")),
    "SELECT * REPLACE (CAST(is_st AS VARCHAR) AS is_st) FROM crossed",
)


def filtered(name: str, condition, sql: str) -> None:
    add(
        name,
        "symbol inst_ownership:4 momentum:6",
        lambda s, d: sel.apply_filters(cross(s, d), condition()),
        f"SELECT * FROM crossed WHERE {sql}",
    )


filtered(
    "filter_range",
    lambda: [fl.in_range("inst_ownership", 0.05, 0.3)],
    "inst_ownership BETWEEN 0.05 AND 0.3",
)
filtered("filter_at_least", lambda: [fl.at_least("inst_ownership", 0.2)], "inst_ownership >= 0.2")
filtered("filter_at_most", lambda: [fl.at_most("inst_ownership", 0.2)], "inst_ownership <= 0.2")
filtered("filter_flag", lambda: [fl.flag("is_st", False)], "is_st = false")
filtered(
    "filter_and_or_not",
    lambda: [
        fl.both(
            fl.either(fl.at_most("inst_ownership", 0.1), fl.at_least("inst_ownership", 0.25)),
            fl.negate(fl.flag("is_st")),
        )
        | fl.negate(fl.at_least("inst_ownership", 0.0))
    ],
    """((inst_ownership <= 0.1 OR inst_ownership >= 0.25) AND NOT coalesce(is_st, false))
    OR NOT coalesce(inst_ownership >= 0, false)""",
)
# A large cross-section with many ties and a hot value: customers by segment.
view(
    "customers",
    """SELECT c_custkey AS symbol, c_mktsegment AS asof,
  CASE WHEN c_custkey % 3 = 0 THEN 500e0 WHEN c_custkey % 11 = 0 THEN NULL
    ELSE round(c_acctbal / 10, 0) * 10 END AS value FROM customer""",
)


def customers(s, d):
    key = F.col("c_custkey")
    value = F.when(key % 3 == 0, F.lit(500.0)).when(
        key % 11 != 0, F.round(F.col("c_acctbal") / 10, 0) * 10
    )
    table = views.table(s, d, "customer")
    return table.select(key.alias("symbol"), F.col("c_mktsegment").alias("asof"), value.alias("value"))


def rank_sql(descending: bool) -> str:
    way = "DESC" if descending else "ASC"
    return f"""CASE WHEN value IS NOT NULL THEN
    (rank() OVER (PARTITION BY asof, value IS NULL ORDER BY value {way})
     + (count(*) OVER (PARTITION BY asof, value) - 1) / 2e0) / count(*) OVER (PARTITION BY asof) END"""


def _both_ranks(s, d):
    best = sel.with_score(customers(s, d), sel.rank_score("value"))
    return sel.with_score(best, sel.rank_score("value", ascending=True), name="inverse")


add(
    "score_rank",
    "asof symbol score:6 inverse:6",
    _both_ranks,
    f"SELECT *, {rank_sql(False)} AS score, {rank_sql(True)} AS inverse FROM customers",
)
# All values within a millionth of each other, half of the rows with the same one.
view(
    "narrow",
    """SELECT c_custkey AS symbol, c_mktsegment AS asof,
  CASE WHEN c_custkey % 2 = 0 THEN 100e0 ELSE 100e0 + (c_custkey * 7919 % 4999) * 1e-9 END AS value FROM customer""",
)


def narrow(s, d):
    key = F.col("c_custkey")
    near = 100.0 + (key * 7919 % 4999) * F.lit(1e-9)
    value = F.when(key % 2 == 0, F.lit(100.0)).otherwise(near)
    table = views.table(s, d, "customer")
    return table.select(key.alias("symbol"), F.col("c_mktsegment").alias("asof"), value.alias("value"))


add(
    "score_rank_narrow",
    "asof symbol score:6",
    lambda s, d: sel.with_score(narrow(s, d), sel.rank_score("value")),
    f"SELECT *, {rank_sql(False)} AS score FROM narrow",
)
add(
    "score_raw",
    "symbol score:6",
    lambda s, d: sel.with_score(cross(s, d), sel.raw_score("momentum", negate=True), by=()),
    "SELECT *, -momentum AS score FROM crossed",
)


def cross_rank(column: str, way: str) -> str:
    return f"""CASE WHEN {column} IS NOT NULL THEN (rank() OVER (PARTITION BY {column} IS NULL ORDER BY {column} {way})
    + (count(*) OVER (PARTITION BY {column}) - 1) / 2e0) / count(*) OVER () END"""


BLEND_SQL = f"0.7e0 * {cross_rank('inst_ownership', 'DESC')} + 0.3e0 * {cross_rank('momentum', 'ASC')}"


def blended():
    return sel.blend(
        [(0.7, sel.rank_score("inst_ownership", ascending=True)), (0.3, sel.rank_score("momentum"))]
    )


add(
    "score_blend",
    "symbol score:6",
    lambda s, d: sel.with_score(cross(s, d), blended(), by=()),
    f"SELECT *, {BLEND_SQL} AS score FROM crossed",
)
add(
    "select_top_n",
    "symbol position score:6",
    lambda s, d: sel.select_top_n(
        cross(s, d), [fl.at_least("bars", 10), fl.flag("is_st", False)], blended(), 4, by=()
    ),
    f"""SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, symbol) AS position FROM
    (SELECT *, {BLEND_SQL} AS score FROM (SELECT * FROM crossed WHERE bars >= 10 AND is_st = false) c) z
    QUALIFY position <= 4""",
)
add(
    "select_top_customers",
    "asof symbol position score:6",
    lambda s, d: sel.select_top_n(
        customers(s, d), [fl.at_least("value", 100.0)], sel.rank_score("value"), 25
    ),
    f"""SELECT *, row_number() OVER (PARTITION BY asof ORDER BY score DESC NULLS LAST, symbol) AS position FROM
    (SELECT *, {rank_sql(False)} AS score FROM (SELECT * FROM customers WHERE value >= 100) c) z
    QUALIFY position <= 25""",
)

# --- allocation --------------------------------------------------------------


def weights_sql(raw: str, source: str, keys: str = "asof", cap: float = 0.2) -> str:
    return f"""SELECT *, least(raw / sum(raw) OVER (PARTITION BY {keys}) * 0.95e0, {cap}e0) AS weight FROM
    (SELECT *, {raw} AS raw FROM ({source}) s) t WHERE raw > 0"""


view(
    "calendar",
    """SELECT date, row_number() OVER (ORDER BY date) - 1 AS place FROM
  (SELECT DISTINCT CAST(timestamp AS DATE) AS date FROM bars_daily) d""",
)
view(
    "rebalances",
    "SELECT date AS asof FROM calendar WHERE place >= 60 AND (place - 60) % 21 = 0",
)
view(
    "asof_bars",
    """SELECT * FROM (SELECT r.asof, b.*, row_number() OVER (PARTITION BY r.asof, b.symbol ORDER BY b.timestamp DESC) AS age
  FROM rebalances r JOIN bars_daily b ON b.timestamp < CAST(r.asof AS TIMESTAMP)) z WHERE age <= 60""",
)
view("features_asof", features_sql("SELECT * FROM asof_bars", "asof, symbol"))


def dates(s, d):
    return al.rebalance_dates(al.trading_calendar(views.bars_daily(s, d)), 60, 21)


def cross_sections(s, d):
    bars = views.bars_daily(s, d)
    calendar = settle(al.trading_calendar(bars))
    return al.features_asof(bars, al.rebalance_dates(calendar, 60, 21), 60, calendar=calendar)


for name, allocate, raw in (
    ("alloc_equal", al.equal_weight, "1e0"),
    ("alloc_inverse_vol", al.inverse_vol, "CASE WHEN volatility > 0 THEN 1 / volatility END"),
    ("alloc_score", lambda p: al.score_proportional(p, "momentum"), "momentum"),
):
    add(
        name,
        "asof symbol weight:6",
        lambda s, d, a=allocate: a(cross_sections(s, d)),
        weights_sql(raw, "SELECT * FROM features_asof"),
    )
add(
    "trading_calendar",
    "date",
    lambda s, d: al.trading_calendar(views.bars_daily(s, d)),
    "SELECT date FROM calendar",
)
add("rebalance_dates", "asof", dates, "SELECT asof FROM rebalances")
add("features_asof", f"asof symbol {FEATURES}", cross_sections, "SELECT * FROM features_asof")

# A filter that empties some dates, so the schedule holds flat periods.
PICKS = """SELECT *, row_number() OVER (PARTITION BY asof ORDER BY score DESC NULLS LAST, symbol) AS position FROM
  (SELECT *, (rank() OVER (PARTITION BY asof ORDER BY momentum) + (count(*) OVER (PARTITION BY asof, momentum) - 1) / 2e0)
    / count(*) OVER (PARTITION BY asof) AS score FROM features_asof WHERE momentum >= 0.04 AND bars >= 20) z
  QUALIFY position <= 3"""
view("schedule", weights_sql("CASE WHEN volatility > 0 THEN 1 / volatility END", PICKS))


def schedule(s, d):
    return al.periodic_schedule(
        views.bars_daily(s, d),
        [fl.at_least("momentum", 0.04), fl.at_least("bars", 20)],
        sel.rank_score("momentum"),
        3,
        al.inverse_vol,
    )


def _schedule_rows(s, d):
    all_dates, weights = schedule(s, d)
    return all_dates.join(weights, "asof", "left")


add(
    "periodic_schedule",
    "asof symbol weight:6",
    _schedule_rows,
    "SELECT r.asof, symbol, weight FROM rebalances r LEFT JOIN schedule USING (asof)",
)
add(
    "union_universe",
    "symbol",
    lambda s, d: al.union_universe(schedule(s, d)[1]),
    "SELECT DISTINCT symbol FROM schedule",
)


def budgeted(s, d):
    bars = bt.backtest(views.bars_daily(s, d), bt.sma_cross())
    return al.active_budget(bars, *schedule(s, d))


view("bt_for_budget", backtest_sql(f"SELECT *, {SMA_TARGET} AS target FROM bars_daily"))
view(
    "budgeted",
    """SELECT b.*, coalesce(w.weight, 0e0) AS budget FROM
  (SELECT * FROM bt_for_budget b ASOF LEFT JOIN rebalances r ON CAST(b.timestamp AS DATE) >= r.asof) b
  LEFT JOIN schedule w ON w.asof = b.asof AND w.symbol = b.symbol""",
)
add(
    "active_budget",
    "symbol timestamp budget:6",
    budgeted,
    "SELECT symbol, timestamp, budget FROM budgeted",
)
add(
    "budgeted_weight",
    "symbol timestamp weight:6",
    lambda s, d: budgeted(s, d).withColumn("weight", al.budgeted_weight("target", "budget", 0.15)),
    "SELECT symbol, timestamp, least(greatest(target * budget, 0), 0.15e0) AS weight FROM budgeted",
)
add(
    "static_budget",
    "symbol timestamp budget:6",
    lambda s, d: al.static_budget(
        views.bars_daily(s, d),
        views.fundamentals(s, d).select("symbol", F.col("inst_ownership").alias("weight")),
    ),
    """SELECT symbol, timestamp, coalesce(inst_ownership, 1e0) AS budget
    FROM bars_daily LEFT JOIN fundamentals USING (symbol)""",
)
add(
    "portfolio_equity",
    "timestamp ret:6 log_equity:6",
    lambda s, d: al.portfolio_equity(budgeted(s, d)).withColumn("log_equity", F.log("equity")),
    """SELECT *, sum(ln(1 + ret)) OVER (ORDER BY timestamp) AS log_equity FROM
    (SELECT timestamp, sum(budget * ret) AS ret FROM budgeted GROUP BY timestamp) z""",
)
