"""Checks of the streaming jobs: a file stream run to its end against the batch result."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.indicators import UPTO
from checks.market_data import BAR, resample_sql
from checks.registry import ORACLES, add, view
from checks.trading import HALT_LIMIT, LIMITS, accounts, holdings, universe
from tapeloom.operators import backtest as bt
from tapeloom.session import checkpoint_root, settle
from tapeloom.sources import views
from tapeloom.streaming import jobs


ARRIVALS = 3


def arrive(spark, df, order: str, start) -> str:
    """Land ``df`` in time order, a third of its span at a time; returns the scratch folder.

    After each landing ``start(stream, root)`` runs the job to the end of what is there, so
    every run but the first resumes from the checkpoint.  File streams order files by their
    modification time, hence one landing after the other.
    """
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/source")
    source = spark.read.schema(df.schema).parquet(f"{root}/source")
    low, high = source.agg(F.min(order), F.max(order)).first()
    edges = [low + (high - low) * k / ARRIVALS for k in range(1, ARRIVALS)]
    for after, upto in zip([None, *edges], [*edges, None]):
        part = source
        if after is not None:
            part = part.where(F.col(order) >= F.lit(after).cast("timestamp_ntz"))
        if upto is not None:
            part = part.where(F.col(order) < F.lit(upto).cast("timestamp_ntz"))
        part.write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/landing")
        start(stream, root).awaitTermination()
    return root


def _validate(s, d):
    def start(stream, root):
        return jobs.stream_validate(stream, f"{root}/good", f"{root}/bad", f"{root}/cp")

    root = arrive(s, views.bars_dirty(s, d), "timestamp", start)
    return s.read.parquet(f"{root}/good").unionByName(s.read.parquet(f"{root}/bad"))


add("stream_validate", f"{BAR} reason", _validate, "SELECT * FROM bars_judged")


def _upsert(s, d):
    def start(stream, root):
        return jobs.stream_dedup_upsert(stream, f"{root}/table", f"{root}/cp")

    root = arrive(s, views.bars_versions(s, d), "ingested_at", start)
    return s.read.parquet(f"{root}/table")


add(
    "stream_dedup_upsert",
    f"{BAR} ingested_at",
    _upsert,
    """SELECT * FROM bars_versions QUALIFY row_number() OVER
    (PARTITION BY symbol, interval, timestamp ORDER BY ingested_at DESC) = 1""",
)

LATENESS = "1 day"


def _resample(target: str, late: bool = False):
    def query(s, d):
        def start(stream, root):
            return jobs.stream_resample_updates(stream, target, f"{root}/bars", f"{root}/cp", LATENESS)

        bars, order = views.bars_minute(s, d), "timestamp"
        if late:  # up to 23 hours behind the newest bar
            delay = F.pmod(F.xxhash64("symbol", "timestamp"), F.lit(24))
            bars, order = bars.withColumn("arrives", F.timestamp_add("HOUR", delay.cast("int"), "timestamp")), "arrives"
        return jobs.newest_buckets(s.read.parquet(f"{arrive(s, bars, order, start)}/bars"))

    return query


add("stream_resample", BAR, _resample("1h"), resample_sql("1h"))
add("stream_resample_late", BAR, _resample("1h", late=True), resample_sql("1h"))
ORACLES["stream_resample_daily"] = ORACLES["resample_daily"]
add("stream_resample_daily", BAR, _resample("1d"))


def _scan(s, d):
    """The sheet after the last micro-batch, when the table holds every bar.

    Minute bars of the same symbols lie in the table as well and are not for the scan.
    """
    bars = views.bars_daily(s, d).unionByName(views.bars_minute(s, d)).withColumn("ingested_at", F.col("timestamp"))
    names, held, money = universe(s, d), settle(holdings(s, d)), accounts(s, d)

    def start(stream, root):
        table, out, state = f"{root}/table", f"{root}/sheets", f"{root}/cp"
        signal = bt.sma_cross()
        return jobs.stream_scan(stream, table, signal, names, held, money, out, state, LIMITS)

    root = arrive(s, bars, "timestamp", start)
    sheets = s.read.parquet(f"{root}/sheets")
    last = sheets.agg(F.max("batch").alias("batch"))
    return sheets.join(F.broadcast(last), "batch")  # one row


add("stream_scan", "account nth symbol side shares price:6 reason", _scan)
ORACLES["stream_scan"] = ORACLES["order_sheet"]


def _monitor(s, d):
    equity = views.bars_minute(s, d).select(
        F.col("symbol").alias("account"), "timestamp", (F.col("close") * 1000).alias("equity")
    )

    def start(stream, root):
        return jobs.stream_equity_monitor(stream, f"{root}/out", f"{root}/cp", HALT_LIMIT)

    root = arrive(s, equity, "timestamp", start)
    return s.read.parquet(f"{root}/out")


view(
    "monitored",
    f"""SELECT *, equity / max(equity) {UPTO.replace('symbol', 'account')} - 1 AS drawdown,
  bool_or(equity <= day_start * (1 - {HALT_LIMIT}e0)) OVER (PARTITION BY account, day ORDER BY timestamp) AS halted FROM
  (SELECT e.*, coalesce(prev, opening) AS day_start FROM
    (SELECT symbol AS account, timestamp, close * 1000 AS equity, CAST(timestamp AS DATE) AS day FROM bars_minute) e
    JOIN (SELECT account, day, opening, lag(closing) OVER (PARTITION BY account ORDER BY day) AS prev FROM
      (SELECT symbol AS account, CAST(timestamp AS DATE) AS day, arg_min(close * 1000, timestamp) AS opening,
        arg_max(close * 1000, timestamp) AS closing FROM bars_minute GROUP BY ALL) q) p USING (account, day)) z""",
)
add(
    "stream_equity_monitor",
    "account timestamp equity:4 day_start:4 drawdown:6 halted",
    _monitor,
    "SELECT * FROM monitored",
)
