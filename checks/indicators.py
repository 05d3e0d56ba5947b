"""Checks of indicators and summary statistics."""
from __future__ import annotations

from dataclasses import replace

from checks.registry import add, view
from tapeloom.operators import indicators as ind
from tapeloom.operators import summary
from tapeloom.operators.series import MINUTE
from tapeloom.plans.explore import explorer_panel
from tapeloom.sources import views

ID = "symbol timestamp"
W = "OVER (PARTITION BY symbol ORDER BY timestamp)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS {n - 1} PRECEDING)"


UPTO = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"


def rolling(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {agg}({x}) {frame(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {W}"


def ewm(source: str, x: str, alpha: str) -> str:
    """Weighted sum over all earlier rows: the recursion written out."""
    return f"""SELECT a.symbol, a.timestamp, a.i,
    sum(CASE WHEN c.i = 1 THEN 1e0 ELSE {alpha} END * c.{x} * pow(1e0 - {alpha}, a.i - c.i)) AS e
    FROM {source} a JOIN {source} c ON a.symbol = c.symbol AND c.i <= a.i GROUP BY ALL"""


def daily(name: str, spec: str, indicator, sql: str) -> None:
    add(
        name,
        f"{ID} {spec}",
        lambda s, d: ind.with_indicators(views.bars_daily(s, d), [indicator().named(name)]),
        sql,
    )


def plain(name: str, digits: int, indicator, expression: str, source: str = "bars_daily") -> None:
    daily(name, f"{name}:{digits}", indicator, f"SELECT *, {expression} AS {name} FROM {source}")


plain("simple_return", 6, ind.simple_return, f"close / {lag('close')} - 1")
plain("log_return", 6, ind.log_return, f"ln(close / {lag('close')})")
plain("cumulative_return", 6, ind.cumulative_return, f"close / first(close) {UPTO} - 1")
plain("drawdown", 6, ind.drawdown, f"close / max(close) {UPTO} - 1")
plain("sma", 4, ind.sma, rolling("avg", "close", 20))
plain(
    "wma",
    4,
    ind.wma,
    f"""CASE WHEN i >= 20 THEN list_sum(list_transform(range(1, 21),
      lambda k: k * (list(close) {frame(20)})[k])) / 210e0 END""",
    "bars_daily_n",
)
plain("roc", 4, ind.roc, f"(close / {lag('close', 10)} - 1) * 100")
plain("momentum", 4, ind.momentum, f"close - {lag('close', 10)}")

view("close_moves", f"SELECT symbol, timestamp, i, coalesce(greatest(close - {lag('close')}, 0), 0) AS up, coalesce(greatest({lag('close')} - close, 0), 0) AS down FROM bars_daily_n")


def rsi_sql(window: int, source: str = "close_moves") -> str:
    alpha = f"(1e0 / {window})"
    return f"""SELECT g.symbol, g.timestamp, g.i, 100 - 100 / (1 + g.e / l.e) AS rsi
    FROM ({ewm(source, 'up', alpha)}) g JOIN ({ewm(source, 'down', alpha)}) l USING (symbol, i)"""


daily("ema", "ema:4", ind.ema, f"SELECT symbol, timestamp, e AS ema FROM ({ewm('bars_daily_n', 'close', '(2e0 / 21)')}) z")
daily("rsi", "rsi:4", ind.rsi, rsi_sql(14))
view(
    "macd_line",
    f"""SELECT f.symbol, f.timestamp, f.i, f.e - s.e AS line
  FROM ({ewm('bars_daily_n', 'close', '(2e0 / 13)')}) f
  JOIN ({ewm('bars_daily_n', 'close', '(2e0 / 27)')}) s USING (symbol, i)""",
)
MACD_SQL = f"""SELECT symbol, m.timestamp, line AS macd_macd, e AS macd_signal, line - e AS macd_histogram
    FROM macd_line m JOIN ({ewm('macd_line', 'line', '(2e0 / 10)')}) z USING (symbol, i)"""
daily("macd", "macd_macd:5 macd_signal:5 macd_histogram:5", ind.macd, MACD_SQL)

HH, LL = rolling("max", "high", 14), rolling("min", "low", 14)
STOCHASTIC_SQL = f"""SELECT *, k AS stochastic_oscillator_percent_k,
    {rolling('avg', 'k', 3)} AS stochastic_oscillator_percent_d
    FROM (SELECT *, 100 * (close - {LL}) / ({HH} - {LL}) AS k FROM bars_daily) z"""
daily(
    "stochastic_oscillator",
    "stochastic_oscillator_percent_k:4 stochastic_oscillator_percent_d:4",
    ind.stochastic_oscillator,
    STOCHASTIC_SQL,
)
plain("williams_r", 4, ind.williams_r, f"-100 * ({HH} - close) / ({HH} - {LL})")
LONG = 1000
LONG_HH, LONG_LL = rolling("max", "high", LONG), rolling("min", "low", LONG)
plain(
    "williams_r_long",
    4,
    lambda: ind.williams_r(LONG),
    f"-100 * ({LONG_HH} - close) / ({LONG_HH} - {LONG_LL})",
)
daily(
    "cci",
    "cci:4",
    ind.cci,
    f"""SELECT *, gap / (0.015e0 * {rolling('avg', 'abs(gap)', 20)}) AS cci FROM
    (SELECT *, tp - {rolling('avg', 'tp', 20)} AS gap FROM
    (SELECT *, (high + low + close) / 3 AS tp FROM bars_daily) t) g""",
)
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
plain("true_range", 4, ind.true_range, TR)
view("true_ranges", f"SELECT symbol, timestamp, i, {TR} AS tr FROM bars_daily_n")
daily("atr", "atr:4", ind.atr, f"SELECT symbol, timestamp, e AS atr FROM ({ewm('true_ranges', 'tr', '(1e0 / 14)')}) z")
MID, DEV = rolling("avg", "close", 20), rolling("stddev_samp", "close", 20)
daily(
    "bollinger_bands",
    "bollinger_bands_middle:4 bollinger_bands_upper:4 bollinger_bands_lower:4",
    ind.bollinger_bands,
    f"""SELECT *, m AS bollinger_bands_middle, m + 2 * s AS bollinger_bands_upper,
    m - 2 * s AS bollinger_bands_lower FROM (SELECT *, {MID} AS m, {DEV} AS s FROM bars_daily) z""",
)
daily(
    "rolling_volatility",
    "rolling_volatility:6",
    ind.rolling_volatility,
    f"""SELECT *, {rolling('stddev_samp', 'lr', 20)} AS rolling_volatility FROM
    (SELECT *, ln(close / {lag('close')}) AS lr FROM bars_daily) z""",
)
plain("typical_price", 6, ind.typical_price, "(high + low + close) / 3")
OBV = f"""SELECT *, sum(flow) {UPTO} AS obv FROM
    (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS flow FROM bars_daily) z"""
daily("obv", "obv:0", ind.obv, OBV)
VWAP = f"sum((high + low + close) / 3 * volume) {UPTO} / sum(volume) {UPTO}"
plain("vwap", 4, ind.vwap, VWAP)
plain("volume_sma", 2, ind.volume_sma, rolling("avg", "volume", 20))

# A panel of every kind of recipe, on the minute bars.
PANEL = [
    ("simple_return", {}, "ret"),
    ("sma", {"window": 10}, "sma10"),
    ("ema", {"span": 12}, "ema12"),
    ("rsi", {"window": 7}, "rsi7"),
    ("bollinger_bands", {}, "bb"),
    ("true_range", {}, "tr"),
    ("drawdown", {}, "dd"),
    ("vwap", {}, "vwap"),
]
PANEL_SPEC = f"{ID} ret:6 sma10:4 ema12:4 rsi7:4 bb_middle:4 bb_upper:4 bb_lower:4 tr:4 dd:6 vwap:4"
view("minute_moves", f"SELECT symbol, timestamp, i, coalesce(greatest(close - {lag('close')}, 0), 0) AS up, coalesce(greatest({lag('close')} - close, 0), 0) AS down FROM bars_minute_n")
PANEL_SQL = f"""SELECT b.*, e.e AS ema12, r.rsi AS rsi7, m AS bb_middle, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower
    FROM (SELECT *, close / {lag('close')} - 1 AS ret, {rolling('avg', 'close', 10)} AS sma10, {MID} AS m, {DEV} AS s,
      {TR} AS tr, close / max(close) {UPTO} - 1 AS dd, {VWAP} AS vwap FROM bars_minute_n) b
    JOIN ({ewm('bars_minute_n', 'close', '(2e0 / 13)')}) e USING (symbol, i)
    JOIN ({rsi_sql(7, 'minute_moves')}) r USING (symbol, i)"""
PANEL_SQL = PANEL_SQL.replace("SELECT b.*, e.e", "SELECT b.symbol, b.timestamp, b.ret, b.sma10, b.tr, b.dd, b.vwap, e.e")
add(
    "metric_panel",
    PANEL_SPEC,
    lambda s, d: ind.metric_panel(views.bars_minute(s, d), PANEL, MINUTE),
    PANEL_SQL,
)
SMALL = replace(MINUTE, cuts=97)  # many small blocks
add(
    "metric_panel_blocks",
    PANEL_SPEC,
    lambda s, d: ind.metric_panel(views.bars_minute(s, d), PANEL, SMALL),
    PANEL_SQL,
)
add(
    "rsi_blocks",
    f"{ID} rsi:4",
    lambda s, d: ind.with_indicators(views.bars_minute(s, d), [ind.rsi(window=7)], SMALL),
    rsi_sql(7, "minute_moves"),
)
EMA_GAP = f"""SELECT a.symbol, a.timestamp, a.i, a.e - b.e AS gap FROM ({ewm('bars_minute_n', 'close', '(2e0 / 13)')}) a
    JOIN ({ewm('bars_minute_n', 'close', '(2e0 / 27)')}) b USING (symbol, i)"""
view("minute_gap", EMA_GAP)
add(
    "macd_blocks",
    f"{ID} macd_macd:4 macd_signal:4 macd_histogram:4",
    lambda s, d: ind.with_indicators(views.bars_minute(s, d), [ind.macd()], SMALL),
    f"""SELECT g.symbol, g.timestamp, gap AS macd_macd, e AS macd_signal, gap - e AS macd_histogram
    FROM minute_gap g JOIN ({ewm('minute_gap', 'gap', '(2e0 / 10)')}) s USING (symbol, i)""",
)

# --- summary -----------------------------------------------------------------


def summary_ctes(source: str, column: str, keys: str) -> str:
    """One row per key with every statistic; sums written out plainly."""
    w = f"(PARTITION BY {keys} ORDER BY timestamp)"
    return f"""SELECT *, cagr / abs(max_drawdown) AS calmar_ratio FROM (
    SELECT {keys}, arg_max(x, timestamp) / arg_min(x, timestamp) - 1 AS total_return,
    pow(arg_max(x, timestamp) / arg_min(x, timestamp), 252e0 / (count(x) - 1)) - 1 AS cagr,
    stddev_samp(r) * sqrt(252e0) AS annualized_volatility,
    avg(r) / stddev_samp(r) * sqrt(252e0) AS sharpe_ratio,
    avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(252e0) AS sortino_ratio,
    min(x / peak - 1) AS max_drawdown
    FROM (SELECT *, x / lag(x) OVER {w} - 1 AS r, max(x) OVER (PARTITION BY {keys} ORDER BY timestamp
      ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, {column} AS x FROM {source}) v) w GROUP BY {keys}) s"""


for metric in summary.ALL_METRICS:
    add(
        metric,
        f"symbol {metric}:6",
        lambda s, d, m=metric: getattr(summary, m)(views.bars_daily(s, d)),
        summary_ctes("bars_daily", "close", "symbol"),
    )
ALL_SPEC = " ".join(f"{m}:6" for m in summary.ALL_METRICS)
add(
    "summary_by_symbol",
    f"symbol {ALL_SPEC}",
    lambda s, d: summary.summary_by_symbol(views.bars_minute(s, d), series=MINUTE),
    summary_ctes("bars_minute", "close", "symbol"),
)
add(
    "summary_blocks",
    f"symbol {ALL_SPEC}",
    lambda s, d: summary.summary_by_symbol(views.bars_minute(s, d), series=SMALL),
    summary_ctes("bars_minute", "close", "symbol"),
)
EXPLORER = [("sma", {"window": 20}, "sma"), ("bollinger_bands", {}, "bb"), ("drawdown", {}, "dd")]


def _explorer(s, d):
    panel, stats = explorer_panel(views.bars_daily(s, d), EXPLORER)
    return panel.join(stats, "symbol")


add(
    "explorer_panel",
    f"{ID} sma:4 bb_upper:4 bb_lower:4 dd:6 total_return:6 sharpe_ratio:6 max_drawdown:6",
    _explorer,
    f"""SELECT p.*, total_return, sharpe_ratio, max_drawdown FROM (SELECT symbol, timestamp, m AS sma,
      m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, dd FROM (SELECT *, {MID} AS m, {DEV} AS s,
      close / max(close) {UPTO} - 1 AS dd FROM bars_daily) z) p
    JOIN ({summary_ctes('bars_daily', 'close', 'symbol')}) t USING (symbol)""",
)
