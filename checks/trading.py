"""Checks of market rules, orders, ledgers and reports."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.indicators import UPTO, lag
from checks.registry import add, view
from checks.strategies import SMA_TARGET
from tapeloom.functions.codes import limit_pct
from tapeloom.operators import backtest as bt
from tapeloom.operators import ledger, market, orders, reports
from tapeloom.operators.series import Series
from tapeloom.session import settle
from tapeloom.sources import views

BAR_ID = "symbol timestamp"
CASH = 50_000_000.0

PCT = """CASE WHEN NOT regexp_full_match(symbol, '[0-9]{3,}') THEN 0.1e0
  WHEN left(symbol, 3) IN ('688', '689', '300', '301') THEN 0.2e0
  WHEN left(symbol, 1) IN ('4', '8') OR left(symbol, 3) = '920' THEN 0.3e0 ELSE 0.1e0 END"""
add(
    "limit_pct",
    "symbol pct:2 n",
    lambda s, d: views.bars_daily(s, d)
    .groupBy("symbol", limit_pct("symbol").alias("pct"))
    .agg(F.count(F.lit(1)).alias("n")),
    f"SELECT symbol, {PCT} AS pct, count(*) AS n FROM bars_daily GROUP BY ALL",
)
BAND = "prev_close:6 up_limit:2 down_limit:2 buy_blocked sell_blocked"


def band_sql(source: str) -> str:
    return f"""SELECT *, volume <= 0 OR coalesce(open >= up_limit, false) AS buy_blocked,
    volume <= 0 OR coalesce(open <= down_limit, false) AS sell_blocked FROM
    (SELECT *, round(prev_close * (1 + {PCT}), 2) AS up_limit, round(prev_close * (1 - {PCT}), 2) AS down_limit
    FROM ({source}) s) b"""


view("banded", band_sql(f"SELECT *, {lag('close')} AS prev_close FROM bars_daily"))
add(
    "limit_band",
    f"{BAR_ID} {BAND}",
    lambda s, d: market.limit_band(views.bars_daily(s, d)),
    "SELECT * FROM banded",
)
DAY_CLOSE = """SELECT symbol, day, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS prev_close FROM
  (SELECT symbol, CAST(timestamp AS DATE) AS day, arg_max(close, timestamp) AS c FROM bars_minute GROUP BY ALL) z"""
add(
    "limit_band_minute",
    f"{BAR_ID} {BAND}",
    lambda s, d: market.limit_band(views.bars_minute(s, d)),
    band_sql(
        f"""SELECT b.*, prev_close FROM bars_minute b JOIN ({DAY_CLOSE}) p
        ON b.symbol = p.symbol AND CAST(b.timestamp AS DATE) = p.day"""
    ),
)
add(
    "suspension_flag",
    f"{BAR_ID} suspended",
    lambda s, d: views.bars_daily(s, d).withColumn("suspended", market.suspension_flag()),
    "SELECT *, volume <= 0 AS suspended FROM bars_daily",
)
add(
    "volume_cap",
    f"{BAR_ID} cap",
    lambda s, d: views.bars_daily(s, d).withColumn("cap", market.volume_cap("volume")),
    "SELECT *, CAST(floor(floor(volume * 0.1e0) / 100) * 100 AS BIGINT) AS cap FROM bars_daily",
)
add(
    "participation",
    "account timestamp seq symbol part:6",
    lambda s, d: views.fills(s, d)
    .join(views.bars_daily(s, d).select(*BAR_ID.split(), "volume"), BAR_ID.split())
    .withColumn("part", market.participation("shares", "volume")),
    """SELECT f.*, CASE WHEN volume > 0 THEN shares / volume ELSE 0 END AS part
    FROM fills f JOIN bars_daily b USING (symbol, timestamp)""",
)
SHARES = """CASE WHEN {w} > 0 THEN CAST(floor({w} * {e} / {p} / 100 + 0.5e0) * 100 AS BIGINT) ELSE 0 END"""
add(
    "target_shares",
    f"{BAR_ID} desired",
    lambda s, d: bt.with_target(views.bars_daily(s, d), bt.sma_cross()).withColumn(
        "desired", market.target_shares(F.col("target") * 0.2, F.lit(1_000_003.0), "close")
    ),
    f"""SELECT *, {SHARES.format(w='target * 0.2e0', e='1000003e0', p='close')} AS desired
    FROM (SELECT *, {SMA_TARGET} AS target FROM bars_daily) t""",
)

# --- ledgers -----------------------------------------------------------------

view("costed", """SELECT *, greatest(notional * 0.00025e0, 5e0) + notional * 0.00011e0
  + CASE WHEN side = 'sell' THEN notional * 0.0005e0 ELSE 0 END AS cost FROM
  (SELECT *, shares * price AS notional FROM fills) f""")  # fmt: skip
view(
    "numbered",
    """SELECT *, sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END) OVER w AS held, row_number() OVER w AS n
  FROM costed WINDOW w AS (PARTITION BY account, symbol ORDER BY timestamp, seq)""",
)
view(
    "averaged",
    """SELECT account, symbol, n, held, price AS e FROM numbered WHERE n = 1 UNION ALL
  SELECT f.account, f.symbol, f.n, f.held, CASE WHEN f.side = 'sell' THEN a.e WHEN a.held <= 0 THEN f.price
    ELSE (a.e * a.held + f.shares * f.price) / f.held END
  FROM averaged a JOIN numbered f ON f.account = a.account AND f.symbol = a.symbol AND f.n = a.n + 1""",
)
view(
    "ledger",
    """SELECT f.* EXCLUDE (held), CAST(f.held AS BIGINT) AS held, CASE WHEN f.held > 0 THEN e END AS avg_price
  FROM numbered f JOIN averaged USING (account, symbol, n)""",
)
FILL_ID = "account timestamp seq symbol side shares price:6"


def enriched(s, d):
    return ledger.fills_enriched(views.fills(s, d))


add(
    "fills_enriched",
    f"{FILL_ID} notional:4 cost:4 reason",
    enriched,
    "SELECT * FROM costed",
)
view(
    "cash",
    f"""SELECT *, {CASH} + sum(CASE WHEN side = 'sell' THEN notional ELSE -notional END - cost)
  OVER (PARTITION BY account ORDER BY timestamp, seq) AS cash FROM costed""",
)
add(
    "cash_ledger",
    "account timestamp seq cash:2",
    lambda s, d: ledger.cash_ledger(enriched(s, d), CASH),
    "SELECT * FROM cash",
)
add(
    "cash_ledger_blocks",
    "account timestamp seq cash:2",
    lambda s, d: ledger.cash_ledger(enriched(s, d), CASH, replace(ledger.ACCOUNT, cuts=97)),
    "SELECT * FROM cash",
)


def positions(s, d):
    return ledger.position_ledger(enriched(s, d))


add(
    "position_ledger",
    f"{FILL_ID} held avg_price:6",
    positions,
    "SELECT * FROM ledger",
)
add(
    "position_ledger_blocks",
    f"{FILL_ID} held avg_price:6",
    lambda s, d: ledger.position_ledger(enriched(s, d), replace(ledger.POSITION, cuts=97)),
    "SELECT * FROM ledger",
)
MARK = "account timestamp symbol shares avg_price:6 price:6 market_value:2 unrealized_pnl:2"
view(
    "marks",
    """SELECT *, shares * price AS market_value, shares * (price - avg_price) AS unrealized_pnl FROM
  (SELECT account, timestamp, symbol, held AS shares, avg_price, coalesce(close, avg_price) AS price FROM
    (SELECT q.*, b.close FROM (SELECT g.account, g.symbol, g.timestamp, held, avg_price FROM
      (SELECT * FROM (SELECT DISTINCT timestamp FROM bars_daily), (SELECT DISTINCT account, symbol FROM fills)) g
      ASOF JOIN (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY account, symbol, timestamp ORDER BY seq DESC) = 1) l
      ON g.account = l.account AND g.symbol = l.symbol AND g.timestamp >= l.timestamp) q
    ASOF LEFT JOIN bars_daily b ON q.symbol = b.symbol AND q.timestamp >= b.timestamp) p WHERE held > 0) m""",
)


def marks(s, d):
    return ledger.mark_to_market(positions(s, d), views.bars_daily(s, d))


add("mark_to_market", MARK, marks, "SELECT * FROM marks")
view(
    "equity",
    f"""SELECT account, timestamp, cash, coalesce(mv, 0) AS market_value, cash + coalesce(mv, 0) AS equity FROM
  (SELECT g.account, g.timestamp, coalesce(c.cash, {CASH}) AS cash FROM
    (SELECT * FROM (SELECT DISTINCT timestamp FROM bars_daily), (SELECT DISTINCT account FROM fills)) g
    ASOF LEFT JOIN (SELECT * FROM cash QUALIFY row_number() OVER (PARTITION BY account, timestamp ORDER BY seq DESC) = 1) c
    ON g.account = c.account AND g.timestamp >= c.timestamp) a
  LEFT JOIN (SELECT account, timestamp, sum(market_value) AS mv FROM marks GROUP BY ALL) m USING (account, timestamp)""",
)


def session_tables(s, d):
    """Enriched fills, marks and equity."""
    trades, bars = enriched(s, d), views.bars_daily(s, d)
    clock = ledger.clock_of(bars)
    marked = ledger.mark_to_market(ledger.position_ledger(trades), bars, clock)
    cash = ledger.cash_ledger(trades, CASH)
    return trades, marked, ledger.equity_curve(cash, marked, bars, CASH, clock)


add(
    "equity_curve",
    "account timestamp cash:2 market_value:2 equity:2",
    lambda s, d: session_tables(s, d)[2],
    "SELECT * FROM equity",
)
HALT_LIMIT = 0.004
add(
    "daily_loss_halt",
    "account timestamp equity:4 day_start:4 halted",
    lambda s, d: market.daily_loss_halt(
        views.bars_minute(s, d).select(
            F.col("symbol").alias("account"), "timestamp", (F.col("close") * 1000).alias("equity")
        ),
        HALT_LIMIT,
    ),
    f"""SELECT account, timestamp, equity, day_start, bool_or(equity <= day_start * (1 - {HALT_LIMIT}e0))
    OVER (PARTITION BY account, day ORDER BY timestamp) AS halted FROM
    (SELECT e.*, coalesce(prev, opening) AS day_start FROM
      (SELECT symbol AS account, timestamp, close * 1000 AS equity, CAST(timestamp AS DATE) AS day FROM bars_minute) e
      JOIN (SELECT account, day, opening, lag(closing) OVER (PARTITION BY account ORDER BY day) AS prev FROM
        (SELECT symbol AS account, CAST(timestamp AS DATE) AS day, arg_min(close * 1000, timestamp) AS opening,
          arg_max(close * 1000, timestamp) AS closing FROM bars_minute GROUP BY ALL) q) p USING (account, day)) z""",
)
add(
    "order_cap",
    "account timestamp seq side nth allowed",
    lambda s, d: orders.order_cap(views.fills(s, d), cap=3),
    """SELECT *, side = 'sell' OR nth <= 3 AS allowed FROM (SELECT *, row_number() OVER
    (PARTITION BY account, CAST(timestamp AS DATE) ORDER BY timestamp, seq) AS nth FROM fills) z""",
)
DAY_ORDERS = Series(("account", "_day"), ("timestamp", "seq"), None, 97)
add(
    "order_cap_blocks",
    "account timestamp seq side nth allowed",
    lambda s, d: orders.order_cap(views.fills(s, d), cap=3, series=DAY_ORDERS),
    """SELECT *, side = 'sell' OR nth <= 3 AS allowed FROM (SELECT *, row_number() OVER
    (PARTITION BY account, CAST(timestamp AS DATE) ORDER BY timestamp, seq) AS nth FROM fills) z""",
)
add(
    "lot_check",
    "account seq shares",
    lambda s, d: orders.lot_check(
        views.fills(s, d).withColumn("shares", F.col("shares") + F.col("seq") % 4 - 1)
    ),
    """SELECT account, seq, shares + seq % 4 - 1 AS shares FROM fills
    WHERE shares + seq % 4 - 1 > 0 AND (shares + seq % 4 - 1) % 100 = 0""",
)

# --- snapshot: holdings on a date, quotes of the newest bars -----------------

SNAPSHOT = "2000-01-03"


def _before(df):
    return df.where(F.col("timestamp") < F.lit(SNAPSHOT).cast("timestamp_ntz"))


def holdings(s, d):
    return ledger.holdings_of(ledger.position_ledger(_before(views.fills(s, d))))


view(
    "holdings",
    f"""SELECT account, symbol, held AS shares, avg_price FROM (SELECT * FROM ledger WHERE timestamp < TIMESTAMP '{SNAPSHOT}'
  QUALIFY row_number() OVER (PARTITION BY account, symbol ORDER BY timestamp DESC, seq DESC) = 1) z WHERE held > 0""",
)
add(
    "holdings",
    "account symbol shares avg_price:6",
    holdings,
    "SELECT * FROM holdings",
)


def accounts(s, d):
    return (
        views.fills(s, d)
        .select("account")
        .distinct()
        .select(
            "account",
            (20_000.0 * (1 + F.col("account"))).alias("cash"),
            (150_000.0 + 10_000.0 * F.col("account")).alias("equity"),
            (20_000.0 * (1 + F.col("account"))).alias("day_start_equity"),
        )
    )


view(
    "accounts",
    """SELECT account, 20000e0 * (1 + account) AS cash, 150000e0 + 10000e0 * account AS equity,
  20000e0 * (1 + account) AS day_start_equity FROM (SELECT DISTINCT account FROM fills) z""",
)


def universe(s, d):
    """The (account, symbol) pairs that ever traded."""
    return views.fills(s, d).select("account", "symbol").distinct()


view("pairs", "SELECT DISTINCT account, symbol FROM fills")


def day_bars(s, d):
    """The newest bar of each symbol up to the snapshot, with its limit band."""
    bars = market.limit_band(views.bars_daily(s, d))
    limit = F.lit(SNAPSHOT).cast("timestamp_ntz")
    newest = bars.where(F.col("timestamp") <= limit).groupBy("symbol").agg(F.max("timestamp").alias("timestamp"))
    return bars.join(newest, ["symbol", "timestamp"])


view(
    "day_bars",
    f"""SELECT * FROM banded WHERE timestamp <= TIMESTAMP '{SNAPSHOT}'
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
)


def candidates(s, d):
    bars = day_bars(s, d).withColumn("price", F.col("open"))
    return bars.join(universe(s, d), "symbol").select("account", *bars.columns)


ROOM = """CASE WHEN price > 0 THEN CAST(greatest(floor(least(greatest(0.2e0 * equity - h * price, 0),
  greatest(0.95e0 * equity - (at_cost - h * a + h * price), 0), cash) / (price * 100)) * 100, 0) AS BIGINT) ELSE 0 END"""
view(
    "sized",
    f"""SELECT *, {ROOM} AS max_shares FROM (SELECT c.*, c.open AS price, account, x.cash, x.equity,
    coalesce(m.shares, 0) AS h, coalesce(m.avg_price, 0) AS a, coalesce(k.at_cost, 0) AS at_cost
  FROM day_bars c JOIN pairs USING (symbol) JOIN accounts x USING (account) LEFT JOIN holdings m USING (account, symbol)
  LEFT JOIN (SELECT account, sum(shares * avg_price) AS at_cost FROM holdings GROUP BY account) k USING (account)) z""",
)
add(
    "max_buy_shares",
    "account symbol price:6 max_shares",
    lambda s, d: orders.max_buy_shares(candidates(s, d), holdings(s, d), accounts(s, d)),
    "SELECT * FROM sized",
)
add(
    "stop_hit",
    "account symbol timestamp stop_price:6 hit fill_price:6",
    lambda s, d: market.stop_hit(holdings(s, d), day_bars(s, d), 0.02),
    """SELECT account, symbol, timestamp, avg_price * (1 - 0.02e0) AS stop_price, low <= avg_price * (1 - 0.02e0) AS hit,
    CASE WHEN low <= avg_price * (1 - 0.02e0) THEN least(open, avg_price * (1 - 0.02e0)) END AS fill_price
    FROM holdings JOIN day_bars USING (symbol)""",
)


def entries(s, d):
    return views.fills(s, d).where("side = 'buy'").select(
        "account", "seq", "symbol", F.col("timestamp").alias("entry_ts"), F.col("price").alias("entry_price")
    )


view("stop_entries", "SELECT account, seq, symbol, timestamp AS entry_ts, price AS entry_price, price * (1 - 0.08e0) AS stop_price FROM fills WHERE side = 'buy'")
add(
    "stop_exit_scan",
    "account seq symbol entry_ts stop_price:6 exit_ts exit_price:6",
    lambda s, d: market.stop_exit_scan(entries(s, d), views.bars_daily(s, d)),
    """SELECT e.*, exit_ts, CASE WHEN exit_ts IS NOT NULL THEN least(opening, stop_price) END AS exit_price FROM stop_entries e
    LEFT JOIN (SELECT account, seq, min(b.timestamp) AS exit_ts, arg_min(b.open, b.timestamp) AS opening
      FROM stop_entries e JOIN bars_daily b ON e.symbol = b.symbol AND b.timestamp > e.entry_ts AND b.low <= e.stop_price
      GROUP BY account, seq) x USING (account, seq)""",
)
add(
    "t1_sellable",
    "account symbol timestamp bought_today sellable",
    lambda s, d: market.t1_sellable(holdings(s, d), views.fills(s, d), day_bars(s, d)),
    """SELECT h.account, h.symbol, b.timestamp, CAST(coalesce(today, 0) AS BIGINT) AS bought_today,
    CAST(least(greatest(shares - coalesce(today, 0), 0), floor(floor(volume * 0.1e0) / 100) * 100) AS BIGINT) AS sellable
    FROM holdings h JOIN day_bars b USING (symbol) LEFT JOIN
    (SELECT account, symbol, CAST(timestamp AS DATE) AS day, sum(shares) AS today FROM fills WHERE side = 'buy' GROUP BY ALL) t
    ON t.account = h.account AND t.symbol = h.symbol AND t.day = CAST(b.timestamp AS DATE)""",
)
RULES = market.MarketRules(participation_rate=0.5)


def deltas(s, d):
    share = (F.length("symbol") + F.col("account") % 3) / 10.0
    bars = candidates(s, d).withColumns({"signal": share, "budget": F.lit(0.25)})
    return orders.order_delta(bars, holdings(s, d), accounts(s, d), rules=RULES)


add(
    "order_delta",
    "account symbol timestamp desired held side shares price:6",
    deltas,
    f"""SELECT *, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(CASE WHEN delta > 0 THEN
      CASE WHEN buy_blocked THEN 0 ELSE least(delta, max_shares, cap) END
      ELSE CASE WHEN sell_blocked THEN 0 ELSE least(-delta, h, cap) END END AS BIGINT) AS shares, CAST(h AS BIGINT) AS held
    FROM (SELECT *, desired - h AS delta, CAST(floor(floor(volume * 0.5e0) / 100) * 100 AS BIGINT) AS cap FROM
      (SELECT *, {SHARES.format(w='w', e='equity', p='price')} AS desired FROM
        (SELECT *, least(greatest((length(symbol) + account % 3) / 10e0 * 0.25e0, 0), 0.2e0) AS w FROM sized) s1) s2) s3
    WHERE delta <> 0 AND shares > 0""",
)


def deltas_of_a_day(s, d):
    """Some shares were bought today, and one account in four is halted."""
    share = (F.length("symbol") + F.col("account") % 3) / 10.0
    bars = candidates(s, d).withColumns({"signal": share, "budget": F.lit(0.25)})
    held = holdings(s, d)
    today = held.where(F.col("shares") % 200 == 0).select("account", "symbol", F.lit(100).alias("shares"))
    halted = accounts(s, d).withColumn("halted", F.col("account") % 4 == 1)
    return orders.order_delta(bars, held, halted, bought_today=today, rules=RULES)


add(
    "order_delta_t1",
    "account symbol timestamp desired held side shares price:6",
    deltas_of_a_day,
    f"""SELECT *, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(CASE WHEN delta > 0 THEN
      CASE WHEN buy_blocked OR account % 4 = 1 THEN 0 ELSE least(delta, max_shares, cap) END
      ELSE CASE WHEN sell_blocked THEN 0 ELSE least(-delta, greatest(h - CASE WHEN h % 200 = 0 THEN 100 ELSE 0 END, 0), cap) END
      END AS BIGINT) AS shares, CAST(h AS BIGINT) AS held
    FROM (SELECT *, desired - h AS delta, CAST(floor(floor(volume * 0.5e0) / 100) * 100 AS BIGINT) AS cap FROM
      (SELECT *, {SHARES.format(w='w', e='equity', p='price')} AS desired FROM
        (SELECT *, least(greatest((length(symbol) + account % 3) / 10e0 * 0.25e0, 0), 0.2e0) AS w FROM sized) s1) s2) s3
    WHERE delta <> 0 AND shares > 0""",
)
LIMITS = market.RiskLimits(stop=0.03, orders=5)
view(
    "quotes",
    f"""SELECT symbol, timestamp, close AS price, target FROM (SELECT *, {SMA_TARGET} AS target FROM
  (SELECT * FROM bars_daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) <= 250) b) t
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
)


def sheet(s, d):
    return orders.order_sheet(
        views.bars_daily(s, d), bt.sma_cross(), universe(s, d), holdings(s, d), accounts(s, d), LIMITS
    )


add(
    "order_sheet",
    "account nth symbol side shares price:6 reason",
    sheet,
    f"""SELECT account, row_number() OVER (PARTITION BY account ORDER BY phase, symbol) AS nth, symbol, side, shares, price, reason
    FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY phase, symbol) AS place FROM
      (SELECT *, CASE WHEN reason = 'signal' THEN {ROOM} ELSE CAST(h AS BIGINT) END AS shares,
        CASE WHEN reason = 'signal' THEN 'buy' ELSE 'sell' END AS side, CASE WHEN reason = 'stop_loss' THEN 0 ELSE 1 END AS phase
        FROM (SELECT *, CASE WHEN h > 0 AND price <= a * (1 - 0.03e0) THEN 'stop_loss'
            WHEN target > 0 AND h = 0 AND equity > day_start_equity * 0.95e0 THEN 'signal'
            WHEN target <= 0 AND h > 0 THEN 'signal_exit' END AS reason
          FROM (SELECT q.*, account, x.cash, x.day_start_equity, coalesce(m.shares, 0) AS h, coalesce(m.avg_price, 0) AS a,
              coalesce(k.at_cost, 0) AS at_cost, x.cash + coalesce(k.mv, 0) AS equity
            FROM quotes q JOIN pairs USING (symbol) JOIN accounts x USING (account) LEFT JOIN holdings m USING (account, symbol)
            LEFT JOIN (SELECT account, sum(shares * avg_price) AS at_cost, sum(shares * coalesce(price, avg_price)) AS mv
              FROM holdings LEFT JOIN quotes USING (symbol) GROUP BY account) k USING (account)) z1) z2
        WHERE reason IS NOT NULL) z3 WHERE shares > 0) z4 WHERE side = 'sell' OR place <= 5""",
)

# --- reports -----------------------------------------------------------------


def report(s, d):
    return reports.daily_report(*session_tables(s, d))


add(
    "daily_report",
    "account date equity:2 cash:2 market_value:2 fills buys sells costs:4 open_positions",
    lambda s, d: report(s, d)[0],
    """SELECT account, date, equity, cash, market_value, coalesce(n, 0) AS fills, coalesce(nb, 0) AS buys,
    coalesce(ns, 0) AS sells, coalesce(costs, 0) AS costs, coalesce(k, 0) AS open_positions
    FROM (SELECT *, CAST(timestamp AS DATE) AS date FROM equity) e
    LEFT JOIN (SELECT account, CAST(timestamp AS DATE) AS date, count(*) AS n, count(*) FILTER (side = 'buy') AS nb,
      count(*) FILTER (side = 'sell') AS ns, sum(cost) AS costs FROM costed GROUP BY ALL) t USING (account, date)
    LEFT JOIN (SELECT account, CAST(timestamp AS DATE) AS date, count(*) AS k FROM marks GROUP BY ALL) p USING (account, date)""",
)
add(
    "daily_report_trades",
    "account date symbol side shares price:6 cost:6 reason",
    lambda s, d: report(s, d)[1],
    "SELECT *, CAST(timestamp AS DATE) AS date FROM costed",
)
add(
    "daily_report_positions",
    "account date symbol shares avg_price:6 price:6 unrealized_pnl:2",
    lambda s, d: report(s, d)[2],
    "SELECT *, CAST(timestamp AS DATE) AS date FROM marks",
)


def log(s, d):
    trades, marked, equity = session_tables(s, d)
    return reports.telemetry_log(equity, marked, views.bars_daily(s, d), trades)


def log_rows(s, d):
    """The log, with the nested positions of a row as text and as sums."""
    held = F.transform("positions", lambda p: F.concat(p["symbol"], F.lit(":"), p["shares"].cast("bigint").cast("string")))
    worth = F.aggregate("positions", F.lit(0.0), lambda total, p: total + p["market_value"])
    return log(s, d).withColumns({"held": F.array_join(held, ","), "worth": worth})


NO_TEXT, NO_COUNT, NO_VALUE = (f"CAST(NULL AS {t})" for t in ("VARCHAR", "BIGINT", "DOUBLE"))
add(
    "telemetry_log",
    "topic log_time account symbol equity:2 cash:2 drawdown:6 num_positions held worth:2 close:6 volume side shares price:6 cost:6 reason",
    log_rows,
    f"""SELECT 'equity' AS topic, epoch_ns(timestamp) AS log_time, account, {NO_TEXT} AS symbol, equity, cash,
      equity / max(equity) {UPTO.replace('symbol', 'account')} - 1 AS drawdown, {NO_COUNT} AS num_positions, {NO_TEXT} AS held,
      {NO_VALUE} AS worth, {NO_VALUE} AS close, {NO_VALUE} AS volume, {NO_TEXT} AS side, {NO_COUNT} AS shares,
      {NO_VALUE} AS price, {NO_VALUE} AS cost, {NO_TEXT} AS reason FROM equity
    UNION ALL SELECT 'portfolio', epoch_ns(timestamp), account, NULL, any_value(equity), any_value(cash), NULL, count(*),
      string_agg(symbol || ':' || CAST(shares AS BIGINT), ',' ORDER BY symbol), sum(shares * price), NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM marks LEFT JOIN (SELECT account, timestamp, equity, cash FROM equity) e USING (account, timestamp) GROUP BY account, timestamp
    UNION ALL SELECT 'bars', epoch_ns(timestamp), NULL, symbol, NULL, NULL, NULL, NULL, NULL, NULL, close, CAST(volume AS DOUBLE), NULL, NULL, NULL, NULL, NULL
      FROM bars_daily
    UNION ALL SELECT 'fills', epoch_ns(timestamp), account, symbol, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, side, shares, price, cost, reason
      FROM costed""",
)
add(
    "telemetry_topics",
    "topic n first_ns last_ns worst:6 held",
    lambda s, d: log(s, d)
    .groupBy("topic")
    .agg(
        F.count(F.lit(1)).alias("n"),
        F.min("log_time").alias("first_ns"),
        F.max("log_time").alias("last_ns"),
        F.min("drawdown").alias("worst"),
        F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("held"),
    )
    .withColumn("held", F.greatest("held", F.lit(0))),
    f"""SELECT topic, count(*) AS n, min(epoch_ns(timestamp)) AS first_ns, max(epoch_ns(timestamp)) AS last_ns,
    min(dd) AS worst, CAST(sum(k) AS BIGINT) AS held FROM (
      SELECT 'equity' AS topic, timestamp, equity / max(equity) {UPTO.replace('symbol', 'account')} - 1 AS dd, 0 AS k FROM equity
      UNION ALL SELECT 'portfolio', timestamp, NULL, count(*) FROM marks GROUP BY account, timestamp
      UNION ALL SELECT 'bars', timestamp, NULL, 0 FROM bars_daily
      UNION ALL SELECT 'fills', timestamp, NULL, 0 FROM costed) z GROUP BY topic""",
)
add(
    "chart_series",
    f"{BAR_ID} series value:6",
    lambda s, d: reports.chart_series(views.bars_daily(s, d), ["close", "volume"]),
    """SELECT symbol, timestamp, 'close' AS series, close AS value FROM bars_daily
    UNION ALL SELECT symbol, timestamp, 'volume', volume FROM bars_daily""",
)
