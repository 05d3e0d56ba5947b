from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tapeloom.schema import BAR_SCHEMA  # noqa: E402
from tapeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """bars(closes or (o, h, l, c, v) rows, symbol=..., interval=..., start=...) -> DataFrame."""

    def make(rows, symbol="A", interval="1d", start=datetime(2024, 1, 1), step=timedelta(days=1)):
        out = []
        for i, row in enumerate(rows):
            o, h, l, c, v = row if isinstance(row, tuple) else (row, row + 1, row - 1, row, 1000)
            values = [float(x) for x in (o, h, l, c)]
            out.append((symbol, interval, start + i * step, *values, int(v)))
        return spark.createDataFrame(out, BAR_SCHEMA)

    return make


@pytest.fixture(scope="session")
def column():
    """column(df, name): values in (symbol, timestamp) order."""

    def read(df, name, *order):
        rows = df.orderBy(*(order or ("symbol", "timestamp"))).select(F.col(name)).collect()
        return [r[0] for r in rows]

    return read
