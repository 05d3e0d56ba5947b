"""Input views of the operators, derived from the provided parquet tables.

Every view is a single aggregation with fixed-width buffers, so Spark combines on the
map side with hash aggregation and shuffles one row per bar, whatever the key skew.
Prices take a square root so that equal sums, and with them comparisons decided by the
order of floating-point additions, do not occur.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Instrument codes of sym 0..9; they reach every branch of the code rules.
CODES = (
    "600519", "000001", "300750", "688981", "830799",
    "920819", "002594", "601318", "430047", "FAKE001",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(sym: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CODES]), sym.cast("int") + 1)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from ``lineitem``; the sort key packs order, line and cents into a long."""
    cents = F.round(F.col("l_extendedprice") % 1000.0 * 100).cast("bigint")
    sym = F.col("l_suppkey") % 10
    rows = table(spark, sf_dir, "lineitem").select(
        sym.alias("sym"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        "l_quantity",
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 131072 + cents).alias("k"),
        (10.0 * (1 + sym) * (1.0 + F.sqrt(F.col("l_extendedprice") % 1000.0) / 253.0)).alias("px"),
    )
    return (
        rows.groupBy("sym", "timestamp")
        .agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("l_quantity").alias("qty"),
        )
        .select(
            code_of(F.col("sym")).alias("symbol"),
            F.lit("1d").alias("interval"),
            "timestamp",
            "open",
            "high",
            "low",
            "close",
            F.when(F.dayofmonth("timestamp") == 13, F.lit(0))
            .otherwise(F.col("qty") * 100)
            .cast("bigint")
            .alias("volume"),
        )
    )


def bars_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars from ``events``, with the time of day folded into the two sessions."""
    minute = (F.hour("ts") * 60 + F.minute("ts")) % 240
    in_session = F.when(minute < 120, minute + 90).otherwise(minute + 180)
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("sym"),
        "event_id",
        (100.0 + F.sqrt(F.col("value") % 50.0)).alias("px"),
        F.timestamp_add(
            "MINUTE", in_session, F.to_date("ts").cast("timestamp_ntz")
        ).alias("timestamp"),
    )
    return (
        rows.groupBy("sym", "timestamp")
        .agg(
            F.min_by("px", "event_id").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "event_id").alias("close"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            code_of(F.col("sym")).alias("symbol"),
            F.lit("1m").alias("interval"),
            "timestamp",
            "open",
            "high",
            "low",
            "close",
            (F.col("n") * 100).cast("bigint").alias("volume"),
        )
    )


def bars_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars, those of every seventh minute written again a day later."""
    first = bars_minute(spark, sf_dir).withColumn("ingested_at", F.col("timestamp"))
    again = first.where(F.minute("timestamp") % 7 == 0).withColumns(
        {
            "close": F.least(F.col("close") * 1.01, F.col("high")),
            "ingested_at": F.col("timestamp") + F.make_dt_interval(F.lit(1)),
        }
    )
    return first.unionByName(again)


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with one fault each on days 3, 5, 7 and 9 of the month."""
    day = F.dayofmonth("timestamp")
    return bars_daily(spark, sf_dir).withColumns(
        {
            "volume": F.when(day == 3, F.lit(-1).cast("bigint")).otherwise(F.col("volume")),
            "high": F.when(day == 5, F.col("low") - 1).otherwise(F.col("high")),
            "open": F.when(day == 7, F.col("high") + 1).otherwise(F.col("open")),
            "close": F.when(day == 9, F.col("low") - 1).otherwise(F.col("close")),
        }
    )


def vendor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as text under the vendor's column names, in lots."""
    bad = F.dayofmonth("timestamp") == 28
    close = F.when(bad, F.lit("bad")).otherwise(F.col("close").cast("string"))
    return bars_daily(spark, sf_dir).select(
        "symbol",
        F.date_format("timestamp", "yyyy-MM-dd").alias("日期"),
        F.col("open").cast("string").alias("开盘"),
        F.col("high").cast("string").alias("最高"),
        F.col("low").cast("string").alias("最低"),
        close.alias("收盘"),
        (F.col("volume") / 100).cast("string").alias("成交量"),
    )


def vendor_epoch(spark: SparkSession, sf_dir: str, interval: str = "1m") -> DataFrame:
    """Bars keyed by a day label and epoch milliseconds."""
    bars = bars_minute(spark, sf_dir) if interval == "1m" else bars_daily(spark, sf_dir)
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return bars.select(
        "symbol",
        F.date_format("timestamp", "yyyyMMdd").alias("label"),
        (F.timestamp_diff("SECOND", epoch, F.col("timestamp")) * 1000).alias("time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw instrument rows; odd rows use the other pair of names, every 7th code is blank."""
    key = F.col("s_suppkey")
    code = F.when(key % 7 == 0, F.lit("  ")).otherwise(F.concat(code_of(key % 10), F.lit(" ")))
    name, even = F.concat(F.lit(" "), F.col("s_name")), key % 2 == 0
    return table(spark, sf_dir, "supplier").select(
        F.when(even, code).alias("code"),
        F.when(even, name).alias("name"),
        F.when(~even, code).alias("代码"),
        F.when(~even, name).alias("名称"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sym = F.col("s_suppkey") % 10
    rows = table(spark, sf_dir, "supplier").groupBy(sym.alias("sym"))
    return (
        rows.agg(F.sum("s_acctbal").alias("bal"))
        .where(F.col("sym") < 9)
        .select(
            code_of(F.col("sym")).alias("symbol"),
            (F.col("bal") * 1000000.0).alias("float_mktcap"),
            (F.col("sym") / 20).alias("inst_ownership"),
            (F.col("sym") == 8).alias("is_st"),
        )
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order buys, and sells the same shares one to five days later."""
    sym, key = F.col("o_custkey") % 10, F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    wait = F.make_dt_interval((1 + key % 5).cast("int"))
    buy = F.struct(F.lit("buy").alias("side"), day.alias("timestamp"), (key * 2).alias("seq"), F.lit(7919.0).alias("d"), F.lit("rebalance").alias("reason"))
    why = F.when(key % 3 == 0, "stop_loss").otherwise("rebalance")
    sell = F.struct(F.lit("sell").alias("side"), (day + wait).alias("timestamp"), (key * 2 + 1).alias("seq"), F.lit(7907.0).alias("d"), why.alias("reason"))
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_totalprice", F.explode(F.array(buy, sell)).alias("f"))
        .select(
            (F.col("o_custkey") % 4).alias("account"),
            "f.timestamp",
            "f.seq",
            code_of(sym).alias("symbol"),
            "f.side",
            (100 * (1 + sym % 3)).cast("bigint").alias("shares"),
            (10.0 * (1 + sym) * (1.0 + F.col("o_totalprice") % 1000.0 / F.col("f.d"))).alias("price"),
            "f.reason",
        )
    )
