"""Checks of sources, tables and resampling."""
from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from checks.registry import add, code_sql, view
from tapeloom.functions.codes import from_exchange_code, to_exchange_code
from tapeloom.operators.resample import resample, session_bucket
from tapeloom.schema import INTERVAL_MINUTES, interval_minutes, is_intraday
from tapeloom.session import checkpoint_root
from tapeloom.sources import ingest, tables, views

BAR = "symbol interval timestamp open:8 high:8 low:8 close:8 volume"
MARCH = (datetime(1997, 3, 1), datetime(1998, 9, 15))
PICKED = ["600519", "300750", "FAKE001"]

add(
    "read_bars",
    BAR,
    lambda s, d: tables.read_bars(views.bars_daily(s, d), PICKED, "1d", *MARCH),
    """SELECT * FROM bars_daily WHERE symbol IN ('600519', '300750', 'FAKE001') AND interval = '1d'
    AND timestamp >= TIMESTAMP '1997-03-01' AND timestamp < TIMESTAMP '1998-09-15'""",
)



def fresh(s, purpose: str) -> tuple[str, str]:
    """A table name and a folder that no other run uses."""
    name = f"{purpose}_{uuid.uuid4().hex}"
    return name, f"{checkpoint_root(s)}/{name}"


def _written(s, d):
    name, folder = fresh(s, "bars")
    tables.create_bars_table(s, name, folder)
    tables.create_bars_table(s, name, folder)
    n = tables.write_bars(views.bars_daily(s, d).unionByName(views.bars_minute(s, d)), name)
    return tables.read_bars(s.table(name), ordered=False).withColumn("written", F.lit(n))


def _artifacts(s, d):
    _, folder = fresh(s, "artifacts")
    closes = views.bars_daily(s, d).select(F.col("symbol").alias("spec_key"), "timestamp", F.col("close").alias("equity"))
    tables.write_artifacts(closes, folder)
    tables.write_artifacts(closes, folder)  # a second write replaces the first
    return s.read.parquet(folder)


add(
    "write_bars",
    f"{BAR} written",
    _written,
    """SELECT *, (SELECT count(*) FROM bars_daily) + (SELECT count(*) FROM bars_minute) AS written
    FROM (SELECT * FROM bars_daily UNION ALL BY NAME SELECT * FROM bars_minute) z""",
)
add("equity_artifacts", "spec_key timestamp equity", _artifacts, "SELECT symbol AS spec_key, timestamp, close AS equity FROM bars_daily")
view(
    "bars_versions",
    """SELECT *, timestamp AS ingested_at FROM bars_minute UNION ALL
  SELECT symbol, interval, timestamp, open, high, low, least(close * 1.01e0, high), volume,
  timestamp + INTERVAL 1 DAY FROM bars_minute WHERE minute(timestamp) % 7 = 0""",
)
add(
    "dedup_bars",
    BAR + " ingested_at",
    lambda s, d: tables.dedup_bars(views.bars_versions(s, d)),
    """SELECT * FROM bars_versions QUALIFY row_number() OVER
    (PARTITION BY symbol, interval, timestamp ORDER BY ingested_at DESC) = 1""",
)
add(
    "latest_timestamp",
    "symbol interval latest",
    lambda s, d: tables.latest_timestamps(
        views.bars_daily(s, d).unionByName(views.bars_minute(s, d))
    ),
    """SELECT symbol, interval, max(timestamp) AS latest FROM
    (SELECT * FROM bars_daily UNION ALL SELECT * FROM bars_minute) u GROUP BY ALL""",
)
add(
    "list_symbols",
    "symbol",
    lambda s, d: tables.list_symbols(
        views.bars_daily(s, d).unionByName(views.bars_minute(s, d)), "1m"
    ),
    "SELECT DISTINCT symbol FROM bars_minute",
)

view(
    "bars_dirty",
    """SELECT symbol, interval, timestamp,
  CASE WHEN day(timestamp) = 7 THEN high + 1 ELSE open END AS open,
  CASE WHEN day(timestamp) = 5 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN day(timestamp) = 9 THEN low - 1 ELSE close END AS close,
  CASE WHEN day(timestamp) = 3 THEN CAST(-1 AS BIGINT) ELSE volume END AS volume FROM bars_daily""",
)
view(
    "bars_judged",
    """SELECT *, CASE WHEN volume < 0 THEN 'negative volume' WHEN high < low THEN 'high below low'
  WHEN open < low OR open > high THEN 'open outside range'
  WHEN close < low OR close > high THEN 'close outside range' END AS reason FROM bars_dirty""",
)
add(
    "validate_bars",
    BAR + " reason",
    lambda s, d: ingest.tag_faults(views.bars_dirty(s, d)),
    "SELECT * FROM bars_judged",
)
add(
    "skip_report",
    "symbol skipped",
    lambda s, d: ingest.skip_report(ingest.validate_bars(views.bars_dirty(s, d))[1]),
    "SELECT symbol, count(*) AS skipped FROM bars_judged WHERE reason IS NOT NULL GROUP BY symbol",
)
add(
    "normalize_daily_vendor",
    BAR,
    lambda s, d: ingest.normalize_daily(views.vendor_daily(s, d)),
    "SELECT * FROM bars_daily WHERE day(timestamp) <> 28",
)
add(
    "normalize_minute_vendor",
    BAR,
    lambda s, d: ingest.normalize_epoch(views.vendor_epoch(s, d), "1m").unionByName(
        ingest.normalize_epoch(views.vendor_epoch(s, d, "1d"), "1d", 10)
    ),
    """SELECT * FROM bars_minute UNION ALL
    SELECT symbol, interval, timestamp, open, high, low, close, volume * 10 FROM bars_daily""",
)
SUFFIXED = """symbol || CASE WHEN left(symbol, 1) IN ('0', '1', '2', '3') THEN '.SZ'
  WHEN left(symbol, 1) IN ('4', '8') THEN '.BJ' ELSE '.SH' END"""
add(
    "to_exchange_code",
    "symbol code n",
    lambda s, d: views.bars_daily(s, d)
    .groupBy("symbol", to_exchange_code("symbol").alias("code"))
    .agg(F.count(F.lit(1)).alias("n")),
    f"SELECT symbol, {SUFFIXED} AS code, count(*) AS n FROM bars_daily GROUP BY ALL",
)
add(
    "from_exchange_code",
    "code symbol n",
    lambda s, d: views.bars_daily(s, d)
    .withColumn("code", to_exchange_code("symbol"))
    .groupBy("code", from_exchange_code("code").alias("symbol"))
    .agg(F.count(F.lit(1)).alias("n")),
    f"SELECT {SUFFIXED} AS code, symbol, count(*) AS n FROM bars_daily GROUP BY ALL",
)
view(
    "universe",
    """SELECT trim(code) AS symbol, trim(name) AS name FROM
  (SELECT CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE """
    + code_sql("s_suppkey % 10")
    + """ END AS code, s_name AS name FROM supplier) z WHERE trim(code) <> ''""",
)
add(
    "normalize_universe",
    "symbol name",
    lambda s, d: ingest.normalize_universe(views.instruments(s, d)),
    "SELECT * FROM universe",
)

ORIGIN = datetime(1990, 1, 1)
CUT = "2000-06-30"


def _plan(s, d):
    universe = ingest.normalize_universe(views.instruments(s, d)).select("symbol").distinct()
    stored = views.bars_daily(s, d).where((F.col("timestamp") < F.lit(CUT).cast("timestamp_ntz")) & (F.col("symbol") != "000001"))
    return universe, ingest.sync_plan(universe, tables.latest_timestamps(stored), ORIGIN)


view(
    "sync_plan",
    """SELECT u.symbol, latest, coalesce(latest - INTERVAL 5 DAY, TIMESTAMP '1990-01-01') AS start
  FROM (SELECT DISTINCT symbol FROM universe) u LEFT JOIN
  (SELECT symbol, max(timestamp) AS latest FROM bars_daily
   WHERE timestamp < TIMESTAMP '2000-06-30' AND symbol <> '000001' GROUP BY symbol) l USING (symbol)""",
)
add("sync_plan", "symbol latest start", lambda s, d: _plan(s, d)[1], "SELECT * FROM sync_plan")


def _incoming(s, d):
    """A fetched batch: for some symbols it ends before what is stored."""
    bars = views.bars_daily(s, d)
    stale = F.col("symbol").isin("300750", "688981")
    return bars.where(~stale | (F.col("timestamp") < F.lit("2000-06-01").cast("timestamp_ntz")))


view(
    "upserted",
    """SELECT b.* FROM (SELECT * FROM bars_daily WHERE symbol NOT IN ('300750', '688981')
    OR timestamp < TIMESTAMP '2000-06-01') b JOIN sync_plan p USING (symbol)
  WHERE timestamp >= start AND (latest IS NULL OR (SELECT max(timestamp) FROM bars_daily c
    WHERE c.symbol = b.symbol AND (c.symbol NOT IN ('300750', '688981') OR c.timestamp < TIMESTAMP '2000-06-01')) > latest)""",
)
add(
    "incremental_upsert",
    BAR,
    lambda s, d: ingest.incremental_upsert(_incoming(s, d), _plan(s, d)[1]),
    "SELECT * FROM upserted",
)


def _report(s, d):
    universe, plan = _plan(s, d)
    failed = F.col("symbol") == "601318"
    written = ingest.incremental_upsert(_incoming(s, d).where(~failed), plan)
    errors = universe.where(failed).select("symbol", F.lit("timeout").alias("error"))
    return ingest.backfill_report(universe, written, errors)


add(
    "backfill_report",
    "total synced skipped failed rows",
    _report,
    """SELECT count(*) AS total, count(*) FILTER (status = 'synced') AS synced,
    count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
    CAST(sum(n) AS BIGINT) AS rows FROM (SELECT symbol, CASE WHEN symbol = '601318' THEN 'failed'
      WHEN coalesce(n, 0) > 0 THEN 'synced' ELSE 'skipped' END AS status,
      CASE WHEN symbol = '601318' THEN 0 ELSE coalesce(n, 0) END AS n
      FROM (SELECT DISTINCT symbol FROM universe) u
      LEFT JOIN (SELECT symbol, count(*) AS n FROM upserted GROUP BY symbol) w USING (symbol)) z""",
)

# --- resampling --------------------------------------------------------------


def _both(s, d):
    return views.bars_daily(s, d).unionByName(views.bars_minute(s, d))


add(
    "interval_minutes",
    "interval minutes intraday n",
    lambda s, d: _both(s, d)
    .groupBy("interval")
    .agg(F.count(F.lit(1)).alias("n"))
    .withColumns({"minutes": interval_minutes("interval"), "intraday": is_intraday("interval")}),
    """SELECT interval, CASE interval WHEN '1m' THEN 1 ELSE 1440 END AS minutes,
    interval = '1m' AS intraday, count(*) AS n FROM
    (SELECT * FROM bars_daily UNION ALL SELECT * FROM bars_minute) u GROUP BY ALL""",
)
MINUTES = {k: v for k, v in INTERVAL_MINUTES.items() if k != "1m"}


def bucket_sql(every: int) -> str:
    return f"""SELECT *, CAST(timestamp + INTERVAL 8 HOUR AS DATE) AS date,
    CASE WHEN m < 720 THEN 570 ELSE 780 END AS session,
    CAST(floor((m - CASE WHEN m < 720 THEN 570 ELSE 780 END) / {every}e0) AS BIGINT) AS bucket
    FROM (SELECT *, hour(timestamp + INTERVAL 8 HOUR) * 60 + minute(timestamp) AS m FROM bars_minute) z"""


add(
    "session_bucket",
    "symbol timestamp date session bucket",
    lambda s, d: views.bars_minute(s, d)
    .withColumn("b", session_bucket("timestamp", 7))
    .select("symbol", "timestamp", "b.*"),
    bucket_sql(7),
)
OHLCV = """arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, timestamp) AS close, CAST(sum(volume) AS BIGINT) AS volume"""


def resample_sql(target: str) -> str:
    return f"""SELECT symbol, '{target}' AS interval, min(timestamp) AS timestamp, {OHLCV}
    FROM ({bucket_sql(MINUTES[target])}) b GROUP BY symbol, date, session, bucket"""


view(
    "bars_resampled_daily",
    f"""SELECT symbol, '1d' AS interval, CAST(date AS TIMESTAMP) AS timestamp, {OHLCV}
  FROM ({bucket_sql(1)}) b GROUP BY symbol, date""",
)
add(
    "resample_intraday",
    BAR,
    lambda s, d: resample(views.bars_minute(s, d), "1h"),
    resample_sql("1h"),
)
for grain in ("5m", "15m", "30m"):
    add(
        f"resample_{grain}",
        BAR,
        lambda s, d, g=grain: resample(views.bars_minute(s, d), g),
        resample_sql(grain),
    )
add(
    "resample_daily",
    BAR,
    lambda s, d: resample(views.bars_minute(s, d), "1d"),
    "SELECT * FROM bars_resampled_daily",
)
add(
    "load_bars",
    BAR,
    lambda s, d: tables.load_bars(
        views.bars_minute(s, d), ["600519", "000001"], "30m",
        datetime(2024, 1, 5), datetime(2024, 1, 20, 3), "1m",
    ),
    f"""SELECT symbol, '30m' AS interval, min(timestamp) AS timestamp, {OHLCV}
    FROM ({bucket_sql(30)}) b WHERE symbol IN ('600519', '000001') AND timestamp >= TIMESTAMP '2024-01-05'
    AND timestamp < TIMESTAMP '2024-01-20 03:00:00' GROUP BY symbol, date, session, bucket""",
)
