"""Checks of signals, backtests and sweeps."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.indicators import ID, SMALL, UPTO, rolling, rsi_sql, summary_ctes
from checks.market_data import fresh
from checks.registry import add, view
from tapeloom.functions.costs import CostModel
from tapeloom.operators import backtest as bt
from tapeloom.operators import ledger
from tapeloom.operators.series import MINUTE
from tapeloom.plans import explore, sweep
from tapeloom.sources import tables, views

COSTS = CostModel()
SMA_TARGET = (
    f"CASE WHEN {rolling('avg', 'close', 10)} > {rolling('avg', 'close', 30)} THEN 1e0 ELSE 0e0 END"
)


def latch_sql(raw: str, source: str) -> str:
    return f"""SELECT *, coalesce(last_value(raw IGNORE NULLS) {UPTO}, 0e0) AS target
    FROM (SELECT *, {raw} AS raw FROM {source}) z"""


view("rsi14", f"SELECT b.*, r.rsi FROM bars_daily_n b JOIN ({rsi_sql(14)}) r USING (symbol, i)")
view("rsi7", f"SELECT b.*, r.rsi FROM bars_daily_n b JOIN ({rsi_sql(7)}) r USING (symbol, i)")
RAW_REVERSION = "CASE WHEN rsi < 30 THEN 1e0 WHEN rsi > 70 THEN 0e0 END"
RAW_SCALED = """CASE WHEN rsi IS NULL OR isnan(rsi) THEN 0e0
    ELSE least(greatest((70 - rsi) / 40e0, 0e0), 1e0) END"""
TARGETS = {
    "sig_buy_and_hold": (bt.buy_and_hold, "SELECT *, 1e0 AS target FROM bars_daily"),
    "sig_sma_cross": (bt.sma_cross, f"SELECT *, {SMA_TARGET} AS target FROM bars_daily"),
    "sig_rsi_reversion": (bt.rsi_reversion, latch_sql(RAW_REVERSION, "rsi14")),
    "sig_scaled_rsi": (bt.scaled_rsi, f"SELECT *, {RAW_SCALED} AS target FROM rsi14"),
}
for name, (signal, target_sql) in TARGETS.items():
    add(
        name,
        f"{ID} target:6",
        lambda s, d, make=signal: bt.with_target(views.bars_daily(s, d), make()),
        target_sql,
    )


def backtest_sql(targets: str, keys: str = "symbol") -> str:
    """Bars of a statement with ``target``, plus the columns of a backtest."""
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp)"
    both = COSTS.commission + COSTS.transfer + COSTS.slippage
    return f"""SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS equity
    FROM (SELECT *, held * coalesce(asset_ret, 0e0) - cost AS ret FROM (SELECT *,
      abs(held - before) * CAST({both} AS DOUBLE) + greatest(before - held, 0e0) * CAST({COSTS.stamp} AS DOUBLE) AS cost
      FROM (SELECT *, coalesce(lag(held) {w}, 0e0) AS before FROM (SELECT *,
        coalesce(lag(target) {w}, 0e0) AS held, close / lag(close) {w} - 1 AS asset_ret
        FROM ({targets}) t) h) b) c) r"""


BACKTESTS = {name: backtest_sql(sql) for name, (_, sql) in TARGETS.items()}
view("bt_sma", BACKTESTS["sig_sma_cross"])
STATS = """total_return, cagr, annualized_volatility AS annual_vol, sharpe_ratio AS sharpe,
  max_drawdown, calmar_ratio AS calmar"""
# The prices revert, so equity runs over many orders of magnitude: compare its logarithm.
GROWTH = "growth:6 cagr:6 annual_vol:6 sharpe:6 max_drawdown:6 calmar:4"


def stats_sql(source: str, keys: str = "symbol") -> str:
    return f"""SELECT *, ln(1 + total_return) AS growth FROM
    (SELECT {keys}, {STATS} FROM ({summary_ctes(source, 'equity', keys)}) m) n"""


def with_growth(stats):
    return stats.withColumn("growth", F.log1p("total_return"))


def _targets(s, d):
    return bt.with_target(views.bars_daily(s, d), bt.sma_cross())


add(
    "held_position",
    f"{ID} target:6 held:6",
    lambda s, d: bt.held_position(_targets(s, d)),
    "SELECT * FROM bt_sma",
)
add(
    "turnover_cost",
    f"{ID} held:6 cost:9",
    lambda s, d: bt.turnover_cost(bt.held_position(_targets(s, d))),
    "SELECT * FROM bt_sma",
)


def _fills_with_part(s, d):
    return views.fills(s, d).withColumn("participation", (F.col("seq") % 97) / 1000.0)


FULL_COST = """greatest(notional * 0.00025e0, 5e0) + notional * (0.00001e0 + 0.0001e0 + 0.1e0 * sqrt(part))
    + CASE WHEN side = 'sell' THEN notional * 0.0005e0 ELSE 0 END"""
add(
    "trade_cost",
    "account timestamp seq symbol side notional:4 cost:4",
    lambda s, d: ledger.fills_enriched(_fills_with_part(s, d)),
    f"""SELECT *, {FULL_COST} AS cost FROM
    (SELECT *, shares * price AS notional, (seq % 97) / 1000e0 AS part FROM fills) z""",
)
add(
    "backtest",
    f"{ID} target:6 asset_ret:6 held:6 cost:9 ret:6 log_equity:6",
    lambda s, d: bt.backtest(views.bars_daily(s, d), bt.sma_cross()).withColumn(
        "log_equity", F.log("equity")
    ),
    "SELECT *, ln(equity) AS log_equity FROM bt_sma",
)
add(
    "backtest_stats",
    f"symbol {GROWTH}",
    lambda s, d: with_growth(
        bt.backtest_stats(bt.backtest(views.bars_daily(s, d), bt.sma_cross()))
    ),
    stats_sql("bt_sma"),
)


def _bucketed(s, d):
    """The same backtest over a catalog table bucketed by symbol."""
    name, folder = fresh(s, "bucketed")
    tables.save_bucketed(views.bars_daily(s, d), name, 8, folder)
    return with_growth(bt.backtest_stats(bt.backtest(s.table(name), bt.sma_cross())))


add("backtest_bucketed", f"symbol {GROWTH}", _bucketed, stats_sql("bt_sma"))


def _minute_reversion(s, d, series=MINUTE):
    """A latched signal on carried averages, and two carry passes."""
    frame = bt.backtest(views.bars_minute(s, d), bt.rsi_reversion(window=7), series=series)
    return with_growth(bt.backtest_stats(frame, series=series))


MINUTE_RSI = f"SELECT b.*, r.rsi FROM bars_minute_n b JOIN ({rsi_sql(7, 'minute_moves')}) r USING (symbol, i)"
view("minute_rsi7", MINUTE_RSI)
view("bt_minute", backtest_sql(latch_sql(RAW_REVERSION, "minute_rsi7")))
add("backtest_minute", f"symbol {GROWTH}", _minute_reversion, stats_sql("bt_minute"))
add("backtest_blocks", f"symbol {GROWTH}", lambda s, d: _minute_reversion(s, d, SMALL), stats_sql("bt_minute"))
add(
    "build_signal",
    f"strategy {ID} target:6",
    lambda s, d: reduce(
        DataFrame.unionByName,
        [
            bt.with_target(views.bars_daily(s, d), bt.build_signal(name, params)).withColumn("strategy", F.lit(name))
            for name, params in (("sma_cross", {"fast": 10, "slow": 30}), ("scaled_rsi", {"window": 14}))
        ],
    ),
    f"""SELECT 'sma_cross' AS strategy, symbol, timestamp, target FROM ({TARGETS['sig_sma_cross'][1]}) a
    UNION ALL SELECT 'scaled_rsi', symbol, timestamp, target FROM ({TARGETS['sig_scaled_rsi'][1]}) b""",
)
add(
    "trades",
    f"{ID} close:6 held:6 delta:6",
    lambda s, d: bt.trades(bt.backtest(views.bars_daily(s, d), bt.sma_cross())),
    "SELECT *, held - before AS delta FROM bt_sma WHERE held <> before",
)
COMPARED = [("buy_and_hold", {}), ("sma_cross", {}), ("rsi_reversion", {}), ("scaled_rsi", {})]
NAMES = ("buy_and_hold", "sma_cross_10_30", "rsi_reversion_14", "scaled_rsi_14")
for key, sql in BACKTESTS.items():
    view(f"bt_{key}", sql)
add(
    "multi_strategy_compare",
    f"strategy symbol {GROWTH}",
    lambda s, d: with_growth(explore.multi_strategy_compare(views.bars_daily(s, d), COMPARED)),
    " UNION ALL ".join(
        f"SELECT '{label}' AS strategy, q.* FROM ({stats_sql(f'bt_{key}')}) q"
        for key, label in zip(BACKTESTS, NAMES)
    ),
)

# --- sweeps ------------------------------------------------------------------

FAST, SLOW, WINDOWS = (5, 10, 20), (30, 60), (7, 14)


def specs(s, *, failing: bool = False):
    out = sweep.param_grid(s, "sma_cross", fast=FAST, slow=SLOW)
    out = out.unionByName(sweep.param_grid(s, "rsi_reversion", window=WINDOWS))
    return out.unionByName(sweep.param_grid(s, "guess")) if failing else out


def _label():
    return F.concat_ws(
        "_", "strategy", F.transform(F.array_sort(F.map_values("params")), lambda v: v.cast("int"))
    )


def _swept(s, d):
    chosen = specs(s)
    stats = with_growth(sweep.sweep(views.bars_daily(s, d), chosen))
    named = chosen.select("spec_key", _label().alias("spec"))
    return stats.join(named, "spec_key")


view("sweep_means", f"SELECT *, {', '.join(f'{rolling('avg', 'close', n)} AS m{n}' for n in (*FAST, *SLOW))} FROM bars_daily")
SWEEP_TARGETS = " UNION ALL ".join(
    [
        f"""SELECT 'sma_cross_{a}_{b}' AS spec, symbol, timestamp, close,
        CASE WHEN m{a} > m{b} THEN 1e0 ELSE 0e0 END AS target FROM sweep_means"""
        for a in FAST
        for b in SLOW
    ]
    + [
        f"""SELECT 'rsi_reversion_{n}' AS spec, symbol, timestamp, close, target
        FROM ({latch_sql(RAW_REVERSION, f'rsi{n}')}) q"""
        for n in WINDOWS
    ]
)
view("bt_sweep", backtest_sql(SWEEP_TARGETS, "spec, symbol"))
view("sweep_stats", stats_sql("bt_sweep", "spec, symbol"))
def _per_symbol(s, d):
    """The grid laid over every symbol with its number of bars."""
    rows = specs(s, failing=True).select("spec_key", "strategy", _label().alias("spec")).collect()
    numbered = s.createDataFrame(
        [(n, *row) for n, row in enumerate(rows)],
        "k int, spec_key string, strategy string, spec string",
    )
    bars = views.bars_daily(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))
    return bars.withColumn("k", every).join(numbered, "k")


add(
    "param_grid",
    "strategy spec symbol n",
    _per_symbol,
    f"""SELECT strategy, spec, symbol, count(*) AS n FROM bars_daily, (VALUES
    {', '.join(f"('sma_cross', 'sma_cross_{a}_{b}')" for a in FAST for b in SLOW)},
    {', '.join(f"('rsi_reversion', 'rsi_reversion_{n}')" for n in WINDOWS)}, ('guess', 'guess')) v(strategy, spec)
    GROUP BY ALL""",
)


def key_sql(spec: str, strategy: str, params: dict) -> str:
    """The key of a spec: SHA-1 of its JSON with sorted parameters, null fields left out."""
    values = ",".join(f'"{k}":{float(v)}' for k, v in sorted(params.items()))
    form = f'{{"strategy":"{strategy}","params":{{{values}}},"constants":"{{}}"}}'
    return f"('{spec}', '{strategy}', substr(sha1('{form}'), 1, 12))"


KEYS = [key_sql(f"sma_cross_{a}_{b}", "sma_cross", {"fast": a, "slow": b}) for a in FAST for b in SLOW]
KEYS += [key_sql(f"rsi_reversion_{n}", "rsi_reversion", {"window": n}) for n in WINDOWS] + [key_sql("guess", "guess", {})]
add(
    "spec_key",
    "spec_key strategy symbol n",
    _per_symbol,
    f"""SELECT spec_key, strategy, symbol, count(*) AS n FROM bars_daily,
    (VALUES {', '.join(KEYS)}) v(spec, strategy, spec_key) GROUP BY ALL""",
)
AXES = {"fast": "month(timestamp) + 1", "slow": "20 + 10 * quarter(timestamp)", "window": "day(timestamp)"}


def _axes_grid(s, d):
    """Grids over values that the bars hold: windows from the calendar of the bars."""
    bars = views.bars_daily(s, d)
    axes = [
        bars.select(F.lit(family).alias("strategy"), F.lit(name).alias("name"), F.expr(AXES[name]).alias("value"))
        for family, name in (("sma_cross", "fast"), ("sma_cross", "slow"), ("rsi_reversion", "window"))
    ]
    grid = sweep.axes_grid(reduce(DataFrame.unionByName, axes))
    return grid.select("spec_key", "strategy", *[F.try_element_at("params", F.lit(name)).alias(name) for name in AXES])


view("axes_grid", f"""SELECT 'sma_cross' AS strategy, fast, slow, CAST(NULL AS DOUBLE) AS "window",
    '{{"fast":' || fast || ',"slow":' || slow || '}}' AS params
    FROM (SELECT DISTINCT CAST({AXES['fast']} AS DOUBLE) AS fast FROM bars_daily), (SELECT DISTINCT CAST({AXES['slow']} AS DOUBLE) AS slow FROM bars_daily)
    UNION ALL SELECT DISTINCT 'rsi_reversion', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST({AXES['window']} AS DOUBLE),
    '{{"window":' || CAST({AXES['window']} AS DOUBLE) || '}}' FROM bars_daily""")  # fmt: skip
add("param_grid_axes", "strategy fast slow window", _axes_grid, 'SELECT strategy, fast, slow, "window" FROM axes_grid')
add(
    "spec_key_axes",
    "spec_key strategy fast slow window",
    _axes_grid,
    """SELECT substr(sha1('{"strategy":"' || strategy || '","params":' || params || ',"constants":"{}"}'), 1, 12) AS spec_key,
    strategy, fast, slow, "window" FROM axes_grid""",
)
add("sweep", f"spec symbol {GROWTH}", _swept, "SELECT * FROM sweep_stats")

SETTINGS = {
    "early": ({"universe": ["600519", "000001", "FAKE001"], "end": "1998-01-01"}, "symbol IN ('600519', '000001', 'FAKE001') AND timestamp < '1998-01-01'"),
    "late": ({"start": "1997-07-01", "interval": "1d"}, "timestamp >= '1997-07-01'"),
}


def _windows(s, d):
    chosen = [sweep.param_grid(s, "sma_cross", constants=fixed, label=name, fast=[5], slow=[30]) for name, (fixed, _) in SETTINGS.items()]
    chosen = reduce(DataFrame.unionByName, chosen)
    stats = with_growth(sweep.sweep(views.bars_daily(s, d), chosen))
    return stats.join(chosen.select("spec_key", F.col("label").alias("spec")), "spec_key")


for name, (_, condition) in SETTINGS.items():
    view(f"means_{name}", f"SELECT *, {rolling('avg', 'close', 5)} AS m5, {rolling('avg', 'close', 30)} AS m30 FROM bars_daily WHERE {condition}")
WINDOW_TARGETS = " UNION ALL ".join(
    f"SELECT '{name}' AS spec, symbol, timestamp, close, CASE WHEN m5 > m30 THEN 1e0 ELSE 0e0 END AS target FROM means_{name}"
    for name in SETTINGS
)
view("bt_windows", backtest_sql(WINDOW_TARGETS, "spec, symbol"))
add("sweep_windows", f"spec symbol {GROWTH}", _windows, stats_sql("bt_windows", "spec, symbol"))


def _failures(s, d):
    chosen = specs(s, failing=True)
    stats = sweep.sweep(views.bars_daily(s, d), chosen)
    judged = sweep.sweep_failures(chosen).select("spec_key", _label().alias("spec"), "error")
    counts = stats.groupBy("spec_key").agg(F.count(F.lit(1)).alias("n"))
    out = judged.join(counts, "spec_key", "left")
    failed = F.col("error").isNotNull()
    return out.select("spec", failed.alias("failed"), F.coalesce("n", F.lit(0)).alias("runs"))


add(
    "sweep_failures",
    "spec failed runs",
    _failures,
    """SELECT spec, false AS failed, count(*) AS runs FROM sweep_stats GROUP BY spec
    UNION ALL SELECT 'guess', true, 0""",
)


def _frame(s, d):
    chosen = specs(s, failing=True)
    return sweep.sweep_frame(
        chosen, sweep.sweep(views.bars_daily(s, d), chosen), ("fast", "slow", "window")
    )


add(
    "sweep_frame",
    "strategy param_fast:0 param_slow:0 param_window:0 failed symbol sharpe:6 max_drawdown:6",
    lambda s, d: _frame(s, d).withColumn("failed", F.col("error").isNotNull()),
    """SELECT CASE WHEN spec LIKE 'sma%' THEN 'sma_cross' ELSE 'rsi_reversion' END AS strategy,
    CASE WHEN spec LIKE 'sma%' THEN CAST(split_part(spec, '_', 3) AS DOUBLE) END AS param_fast,
    CASE WHEN spec LIKE 'sma%' THEN CAST(split_part(spec, '_', 4) AS DOUBLE) END AS param_slow,
    CASE WHEN spec LIKE 'rsi%' THEN CAST(split_part(spec, '_', 3) AS DOUBLE) END AS param_window,
    false AS failed, symbol, sharpe, max_drawdown FROM sweep_stats
    UNION ALL SELECT 'guess', NULL, NULL, NULL, true, NULL, NULL, NULL""",
)
add(
    "sweep_best",
    "symbol strategy param_fast:0 param_slow:0 sharpe:6",
    lambda s, d: sweep.sweep_best(
        _frame(s, d).where((F.col("strategy") == "sma_cross") | F.col("error").isNotNull()),
        by=("symbol",),
    ),
    """SELECT symbol, 'sma_cross' AS strategy, sharpe, CAST(split_part(spec, '_', 3) AS DOUBLE) AS param_fast,
    CAST(split_part(spec, '_', 4) AS DOUBLE) AS param_slow FROM sweep_stats WHERE spec LIKE 'sma%'
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC) = 1""",
)
