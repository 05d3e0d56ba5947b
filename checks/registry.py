"""Registry of checked queries: a Spark callable and, where SQL can say it, DuckDB SQL.

A column spec such as ``"symbol timestamp sma:4"`` is applied to both sides; ``:4`` maps
NaN and infinities to NULL and rounds to four places.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.expr import finite
from tapeloom.sources.views import CODES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, int | None]]:
    pairs = [token.partition(":") for token in spec.split()]
    return [(name, int(digits) if digits else None) for name, _, digits in pairs]


def present(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, digits in _columns(spec):
        value = F.col(name) if digits is None else F.round(finite(name), digits)
        out.append(value.alias(name))
    return df.select(*out)


def present_sql(body: str, spec: str) -> str:
    out = []
    for name, digits in _columns(spec):
        if digits is None:
            out.append(f'"{name}"')
        else:
            value = f'CAST("{name}" AS DOUBLE)'
            out.append(f'round(CASE WHEN isfinite({value}) THEN {value} END, {digits}) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) shown"


def add(name: str, spec: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: present(query(spark, sf_dir), spec)
    if sql is not None:
        ORACLES[name] = with_views(present_sql(sql, spec))


VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prepend the views the statement needs, in the order they were defined."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    parts = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed]
    sql = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
    return re.sub(r'(?<!")\basof\b(?!")', '"asof"', sql)  # a keyword in DuckDB, a column here


def code_sql(sym: str) -> str:
    codes = ", ".join(f"'{c}'" for c in CODES)
    return f"list_extract([{codes}], CAST({sym} AS INTEGER) + 1)"


view(
    "bars_daily",
    f"""SELECT {code_sql('sym')} AS symbol, '1d' AS interval, CAST(l_shipdate AS TIMESTAMP) AS timestamp,
  arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
  CAST(CASE WHEN day(l_shipdate) = 13 THEN 0 ELSE sum(l_quantity) * 100 END AS BIGINT) AS volume
  FROM (SELECT l_suppkey % 10 AS sym, l_shipdate, l_quantity,
    (l_orderkey * 8 + l_linenumber) * 131072 + CAST(round((l_extendedprice % 1000e0) * 100) AS BIGINT) AS k,
    10e0 * (1 + l_suppkey % 10) * (1e0 + sqrt(l_extendedprice % 1000e0) / 253e0) AS px FROM lineitem) z
  GROUP BY sym, l_shipdate""",
)
view(
    "bars_minute",
    f"""SELECT {code_sql('sym')} AS symbol, '1m' AS interval, timestamp,
  arg_min(px, event_id) AS open, max(px) AS high, min(px) AS low, arg_max(px, event_id) AS close,
  CAST(count(*) * 100 AS BIGINT) AS volume
  FROM (SELECT user_id % 5 AS sym, event_id, 100e0 + sqrt(value % 50e0) AS px,
    CAST(date_trunc('day', ts) AS TIMESTAMP) + to_minutes(CAST(CASE WHEN m < 120 THEN 90 + m ELSE 180 + m END AS INTEGER)) AS timestamp
    FROM (SELECT *, (hour(ts) * 60 + minute(ts)) % 240 AS m FROM events) e) z
  GROUP BY sym, timestamp""",
)
for grain in ("daily", "minute"):
    view(
        f"bars_{grain}_n",
        f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS i FROM bars_{grain}",
    )

view(
    "fills",
    f"""SELECT o_custkey % 4 AS account, timestamp, seq, {code_sql('o_custkey % 10')} AS symbol, side,
  CAST(100 * (1 + o_custkey % 10 % 3) AS BIGINT) AS shares,
  10e0 * (1 + o_custkey % 10) * (1e0 + (o_totalprice % 1000e0) / d) AS price, reason FROM (
    SELECT *, CAST(o_orderdate AS TIMESTAMP) AS timestamp, o_orderkey * 2 AS seq, 'buy' AS side,
      7919e0 AS d, 'rebalance' AS reason FROM orders
    UNION ALL SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(1 + o_orderkey % 5 AS INTEGER)),
      o_orderkey * 2 + 1, 'sell', 7907e0,
      CASE WHEN o_orderkey % 3 = 0 THEN 'stop_loss' ELSE 'rebalance' END FROM orders) z""",
)
