"""Time the headline queries: one warm-up, then the median of three runs into the noop sink.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""
from __future__ import annotations

import json
import os
import statistics
import time

from checks.catalog import QUERIES
from tapeloom.session import build_session

HEADLINE = (
    "resample_intraday",
    "metric_panel",
    "rsi",
    "macd",
    "summary_by_symbol",
    "backtest_stats",
    "backtest_minute",
    "features_asof",
    "periodic_schedule",
    "sweep",
    "dedup_bars",
    "score_rank",
    "position_ledger",
    "stop_exit_scan",
    "equity_curve",
    "order_sheet",
)
RUNS = 3


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    spark = build_session("bench", master=f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
