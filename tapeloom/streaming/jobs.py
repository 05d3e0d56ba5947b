"""Structured Streaming counterparts of the batch operators.

Stateless and bucketed work runs as ordinary streaming queries.  Work that needs the whole
table or an ordered pass runs the batch operator inside ``foreachBatch``; every micro-batch
writes under its id, so a replay after a failure overwrites its own output.
"""
from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.functions.expr import ieee_div, utc_midnight
from tapeloom.operators.backtest import Signal
from tapeloom.operators.market import RiskLimits
from tapeloom.operators.orders import order_sheet
from tapeloom.operators.resample import local_time, ohlcv, session_bucket
from tapeloom.operators.series import Series, lay_out, running
from tapeloom.schema import BAR_COLUMNS, minutes_of
from tapeloom.sources.ingest import tag_faults
from tapeloom.sources.tables import MONTH, dedup_bars, for_storage, read_bars

SESSION_MINUTES = 240


def _each_batch(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a written parquet folder."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def stream_validate(
    stream: DataFrame,
    out: str,
    bad: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame] = tag_faults,
) -> StreamingQuery:
    """Split a landing stream into valid bars and a quarantine with reasons.

    ``parse`` turns landed rows into bars with ``reason``, e.g. a vendor parser.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        tagged = parse(batch).withColumn("ok", F.col("reason").isNull()).persist()
        for path, keep in ((out, F.col("ok")), (bad, ~F.col("ok"))):
            rows = tagged.where(keep).select(*BAR_COLUMNS, "reason")
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        tagged.unpersist()

    return _each_batch(stream, split, checkpoint)


def merge_into(batch: DataFrame, batch_id: int, table_path: str, staging: str) -> None:
    """Put a batch into a parquet bars table, last write wins.

    Only the (interval, month) partitions the batch touches are read, deduplicated, staged
    and put in place by dynamic partition overwrite.  A batch that was staged as a whole is
    put in place from there when it is replayed, without reading a table that the broken
    attempt may have left half swapped.
    """
    spark = batch.sparkSession
    staged, marker = f"{staging}/merge/batch={batch_id}", f"{staging}/merged/batch={batch_id}"
    if not _exists(spark, marker):
        merged = batch.withColumn("month", F.date_format("timestamp", MONTH))
        if _exists(spark, table_path):
            touched = merged.select("interval", "month").distinct()  # calendar-bounded
            stored = spark.read.schema(merged.schema).parquet(table_path)
            stored = stored.join(touched, ["interval", "month"], "left_semi")
            merged = stored.select(*merged.columns).unionByName(merged)
        for_storage(dedup_bars(merged.drop("month"))).write.mode("overwrite").parquet(staged)
        spark.range(1).write.mode("overwrite").parquet(marker)
    _publish(spark, staged, table_path)


def _publish(spark: SparkSession, staged: str, table_path: str) -> None:
    (
        spark.read.parquet(staged)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("interval", "month")
        .parquet(table_path)
    )


def stream_dedup_upsert(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Idempotent ingest of bars with ``ingested_at`` into a parquet table."""
    return _each_batch(stream, lambda b, i: merge_into(b, i, table_path, checkpoint), checkpoint)


def stream_resample(stream: DataFrame, target: str, lateness: str = "1 day") -> DataFrame:
    """Bars of interval ``target`` from a minute stream; state holds only open buckets.

    The event time is the start of the bucket, so the watermark trails by the bucket's length
    and ``lateness``: every bar at most ``lateness`` behind the newest one is counted.  In
    append mode a bucket is emitted once, when no such bar can reach it any more.
    """
    every = minutes_of(target)
    if target == "1d":
        start = utc_midnight(F.to_date(local_time("timestamp")))
        stamp = F.first("bucket_start").cast("timestamp_ntz")
    else:
        cut, local = session_bucket("timestamp", every), local_time("timestamp")
        minute_of_day = F.hour(local) * 60 + F.minute(local)
        shift = cut["session"] + cut["bucket"].cast("int") * every - minute_of_day
        start = F.timestamp_add("MINUTE", shift, F.date_trunc("MINUTE", "timestamp").cast("timestamp_ntz"))
        stamp = F.min("timestamp")
    return (
        stream.withColumn("bucket_start", start.cast("timestamp"))
        .withWatermark("bucket_start", f"{lateness} {every} minutes")
        .groupBy("symbol", "bucket_start")
        .agg(stamp.alias("timestamp"), *ohlcv())
        .withColumn("interval", F.lit(target))
        .select(*BAR_COLUMNS, "bucket_start")
    )


def stream_resample_updates(
    stream: DataFrame, target: str, out: str, checkpoint: str, lateness: str = "1 day"
) -> StreamingQuery:
    """Write every change of a bucket as it happens, the newest buckets included.

    ``newest_buckets`` reads the bars back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _each_batch(stream_resample(stream, target, lateness), write, checkpoint, "update")


def newest_buckets(updates: DataFrame) -> DataFrame:
    """The last state of every bucket in what ``stream_resample_updates`` has written."""
    rest = [c for c in BAR_COLUMNS if c != "symbol"]
    last = updates.groupBy("symbol", "bucket_start").agg(F.max(F.struct("batch", *rest)).alias("_top"))
    return last.select(*[F.col("symbol") if c == "symbol" else F.col("_top")[c].alias(c) for c in BAR_COLUMNS])


def stream_scan(
    stream: DataFrame,
    table_path: str,
    signal: Signal,
    universe: DataFrame,
    holdings: DataFrame,
    accounts: DataFrame,
    out: str,
    checkpoint: str,
    limits: RiskLimits = RiskLimits(),
    interval: str = "1d",
    lookback: int = 250,
    history_days: int | None = None,
) -> StreamingQuery:
    """After every micro-batch: merge its bars into the table, then write the order sheet.

    The sheet is that of the whole table.  Bars of ``interval`` are read from the months that
    reach back ``history_days`` from the newest bar of the batch (four times the calendar days
    that ``lookback`` bars take, if not given).  The months before are read only when a symbol
    of ``universe`` or ``holdings`` has fewer than ``lookback`` bars there, for such symbols.
    """
    per_day = 1 if interval == "1d" else SESSION_MINUTES // minutes_of(interval)
    days = 4 * max(1, lookback // per_day) + 31 if history_days is None else history_days
    watched = universe.select("symbol").union(holdings.select("symbol")).distinct()

    def scan(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch, batch_id, table_path, checkpoint)
        table = batch.sparkSession.read.parquet(table_path)
        newest = batch.where(F.col("interval") == interval).agg(F.max("timestamp")).first()[0]
        start = None if newest is None else newest - timedelta(days=days)
        bars = read_bars(table, interval=interval, start=start, ordered=False)
        short = watched.join(bars.groupBy("symbol").count(), "symbol", "left")
        short = short.where(F.coalesce("count", F.lit(0)) < lookback).select("symbol").persist()
        if start is not None and short.head(1):
            older = read_bars(table, interval=interval, end=start, ordered=False)
            bars = bars.unionByName(older.join(short, "symbol", "left_semi"))
        sheet = order_sheet(bars, signal, universe, holdings, accounts, limits, lookback)
        sheet.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        short.unpersist()

    return _each_batch(stream, scan, checkpoint)


MONITOR_STATE = "account {0}, day date, day_start double, last double, peak double, halted boolean"
TICKS = Series(("account",), ("timestamp",), None)


def monitor_batch(
    batch: DataFrame, state: DataFrame, max_daily_loss: float
) -> tuple[DataFrame, DataFrame]:
    """(judged rows, next state) of a batch of (account, timestamp, equity).

    The state is one row per account.  Day starts come from the day before, the halt is the
    first breach of a day, and the running peak is a blockwise scan on top of the stored one.
    """
    tagged = batch.select("account", "timestamp", "equity", F.to_date("timestamp").alias("day"))
    prior = state.select(
        "account", *[F.col(c).alias(f"_{c}") for c in ("day", "day_start", "last", "peak", "halted")]
    )
    days = tagged.groupBy("account", "day").agg(
        F.min_by("equity", "timestamp").alias("_open"), F.max_by("equity", "timestamp").alias("_close")
    )
    before = F.lag("_close").over(Window.partitionBy("account").orderBy("day"))  # one row a day
    days = days.withColumn("_before", before).join(prior, "account", "left")
    same = F.coalesce(F.col("day") == F.col("_day"), F.lit(False))
    fresh = F.coalesce("_before", "_last", "_open")
    days = days.withColumns(
        {
            "day_start": F.when(same, F.col("_day_start")).otherwise(fresh),
            "_latched": F.when(same, F.col("_halted")).otherwise(F.lit(False)),
        }
    ).select("account", "day", "day_start", "_latched", "_peak")
    rows = tagged.join(days, ["account", "day"])
    breach = F.col("equity") <= F.col("day_start") * (1 - max_daily_loss)
    firsts = rows.groupBy("account", "day").agg(
        F.min(F.when(breach, F.col("timestamp"))).alias("_from")
    )
    rows = rows.join(firsts, ["account", "day"])
    reached = F.coalesce(F.col("timestamp") >= F.col("_from"), F.lit(False))
    rows = rows.withColumn("halted", F.col("_latched") | reached)
    lay = running(lay_out(rows, TICKS), {"peak": ("max", F.col("equity"))})
    rows = lay.df.withColumn("peak", F.greatest("peak", "_peak"))
    out = rows.select(
        "account",
        "timestamp",
        "equity",
        "day",
        "day_start",
        "peak",
        (ieee_div("equity", "peak") - 1).alias("drawdown"),
        "halted",
    )
    news = out.groupBy("account").agg(
        F.max("day").alias("day"),
        F.max_by("day_start", "timestamp").alias("day_start"),
        F.max_by("equity", "timestamp").alias("last"),
        F.max("peak").alias("peak"),
        F.max_by("halted", "timestamp").alias("halted"),
    )
    kept = state.join(news, "account", "left_anti")
    return out, news.unionByName(kept)


def stream_equity_monitor(
    stream: DataFrame, out: str, checkpoint: str, max_daily_loss: float = 0.05
) -> StreamingQuery:
    """Running peak, drawdown and daily-loss halt of a stream of account equity.

    Micro-batches are taken in order; batch n starts from the state batch n-1 left, and a
    state that is missing is an error.  Rows of a day before the one an account has reached
    cannot change what was judged; they are written to ``{out}_late`` and not judged.
    """
    key_type = stream.schema["account"].dataType.simpleString()

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, MONITOR_STATE.format(key_type)
        state = spark.createDataFrame([], schema)
        if batch_id > 0:
            state = spark.read.schema(schema).parquet(f"{checkpoint}/monitor/batch={batch_id - 1}")
        reached = state.select(F.col("account").alias("_account"), F.col("day").alias("_reached"))
        placed = batch.join(reached, F.col("account") == F.col("_account"), "left")
        late = F.coalesce(F.to_date("timestamp") < F.col("_reached"), F.lit(False))
        placed.where(late).select(*batch.columns).write.mode("overwrite").parquet(f"{out}_late/batch={batch_id}")
        rows, state = monitor_batch(placed.where(~late).select(*batch.columns), state, max_daily_loss)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.write.mode("overwrite").parquet(f"{checkpoint}/monitor/batch={batch_id}")

    return _each_batch(stream, judge, checkpoint)
