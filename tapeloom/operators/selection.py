"""Cross-sections: features, scores and the top-N choice."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.expr import ieee_div
from tapeloom.operators.series import Series, lay_out, running

FEATURES = ("price", "adv", "volatility", "momentum", "bars")
YEAR = 252
#: Shares of a group that are cut to their best rows before these meet.
TOP_SHARES = 64


def newest_bars(df: DataFrame, n: int, asof: datetime | None = None) -> DataFrame:
    """The last ``n`` bars per symbol, strictly before ``asof``, with ``_age`` 1 = newest.

    Rows are limited per symbol and month first, so at most ``n`` rows per month of a symbol
    meet in one task, for any ``n``, and everything after works on at most ``n`` rows per symbol.
    """
    if asof is not None:
        limit = F.lit(asof.isoformat(sep=" ")).cast("timestamp_ntz")
        df = df.where(F.col("timestamp") < limit)
    late = F.col("timestamp").desc()
    monthly = Window.partitionBy("symbol", "_month").orderBy(late)
    df = df.withColumn("_month", F.date_trunc("month", "timestamp")).withColumn("_age", F.row_number().over(monthly))
    df = df.where(F.col("_age") <= n).drop("_month")
    return df.withColumn("_age", F.row_number().over(Window.partitionBy("symbol").orderBy(late))).where(F.col("_age") <= n)


def build_features(
    df: DataFrame,
    asof: datetime | None = None,
    lookback: int = 60,
    fundamentals: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol from its last ``lookback`` bars before ``asof``."""
    recent = newest_bars(df, lookback, asof)
    older = F.lead("close").over(Window.partitionBy("symbol").orderBy(F.col("timestamp").desc()))
    recent = recent.withColumn("_ret", ieee_div("close", older) - 1)
    first, last = F.min_by("close", "timestamp"), F.max_by("close", "timestamp")
    out = recent.groupBy("symbol").agg(
        last.alias("price"),
        F.avg(F.col("close") * F.col("volume")).alias("adv"),
        (F.stddev_samp("_ret") * math.sqrt(YEAR)).alias("volatility"),
        (ieee_div(last, first) - 1).alias("momentum"),
        F.count(F.lit(1)).alias("bars"),
    )
    return join_fundamentals(out, fundamentals) if fundamentals is not None else out


def join_fundamentals(features: DataFrame, fundamentals: DataFrame) -> DataFrame:
    return features.join(fundamentals, "symbol", "left")


# --- scores ------------------------------------------------------------------


@dataclass(frozen=True)
class Score:
    """Weighted sum of terms ``(weight, kind, column, flag)``; ``+`` and ``*`` combine scores."""

    terms: tuple[tuple[float, str, str, bool], ...]

    def __mul__(self, weight: float) -> Score:
        return Score(tuple((w * weight, k, c, f) for w, k, c, f in self.terms))

    __rmul__ = __mul__

    def __add__(self, other: Score) -> Score:
        return Score(self.terms + other.terms)


def rank_score(column: str, ascending: bool = False) -> Score:
    """Average rank over the group size, 1 = best; ``ascending`` prefers low values."""
    return Score(((1.0, "rank", column, ascending),))


def raw_score(column: str, negate: bool = False) -> Score:
    return Score(((1.0, "raw", column, negate),))


def blend(parts: Sequence[tuple[float, Score]]) -> Score:
    return reduce(lambda a, b: a + b, [weight * score for weight, score in parts])


def with_average_rank(
    df: DataFrame,
    column: str,
    by: Sequence[str],
    out: str,
    descending: bool,
    cuts: int | None = None,
) -> DataFrame:
    """``out`` = average rank of ``column`` among the non-NULL values of its group.

    For groups of any size and any distribution: equal values are counted first (map-side),
    and the distinct values are a series in their own order, cut by range into parts of about
    equal size with running totals carried across, so values may lie as close as they like.
    The lookup by value is a plain left join, whose common values adaptive execution splits.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    lay = running(lay_out(values, Series(tuple(by), (column,), None, cuts)), {"_to": ("sum", F.col("_n"))})
    ranks = lay.df.select(*by, column, (F.col("_to") - (F.col("_n") - 1) / 2).alias(out))
    ranked = df.join(ranks, [*by, column], "left")
    if not descending:
        return ranked
    known = df.groupBy(*by).agg(F.count(column).alias("_known"))
    turned = ranked.join(known, list(by)).withColumn(out, F.col("_known") + 1 - F.col(out))
    return turned.select(*df.columns, out)


def with_score(
    df: DataFrame,
    score: Score,
    by: Sequence[str] = ("asof",),
    name: str = "score",
) -> DataFrame:
    """Add the blended score; ranks divide by the size of the group, NULLs stay unranked."""
    columns, total = df.columns, F.lit(0.0)
    if not by:
        df, by = df.withColumn("_group", F.lit(0)), ("_group",)
    ranked = {(c, marked) for _, kind, c, marked in score.terms if kind == "rank"}
    ranks = {pair: f"_rank{n}" for n, pair in enumerate(sorted(ranked))}
    if ranks:
        known = {f"_known_{c}": F.count(c) for c in sorted({c for c, _ in ranks})}
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), *[n.alias(k) for k, n in known.items()])
        for (column, _), out in ranks.items():
            df = with_average_rank(df, column, by, out, False)
        df = df.join(sizes, list(by))
        turned = {out: F.col(f"_known_{c}") + 1 - F.col(out) for (c, marked), out in ranks.items() if marked}
        df = df.withColumns(turned)
    for weight, kind, column, marked in score.terms:
        if kind == "rank":
            term = F.col(ranks[column, marked]) / F.col("_size")
        else:
            term = -F.col(column) if marked else F.col(column)
        total = total + weight * term
    return df.select(*columns, total.alias(name))


def apply_filters(features: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Rows for which every condition holds; an unknown condition drops the row."""
    for condition in filters:
        features = features.where(F.coalesce(condition, F.lit(False)))
    return features


def select_top_n(
    features: DataFrame,
    filters: Sequence[Column] = (),
    score: Score | None = None,
    top_n: int | None = None,
    by: Sequence[str] = ("asof",),
) -> DataFrame:
    """Survivors of the filters, scored among themselves, best ``top_n`` per group.

    Ties and the unscored order fall back to ``symbol``.  ``position`` is added with top_n.
    """
    kept = apply_filters(features, filters)
    if score is not None:
        kept = with_score(kept, score, by)
    if top_n is None:
        return kept
    order = [F.col("symbol")]
    if score is not None:
        order.insert(0, F.col("score").desc_nulls_last())
    # Two stages, so that of a group of any size only top_n rows per share meet in one task.
    share = F.pmod(F.xxhash64("symbol"), F.lit(TOP_SHARES))
    within = Window.partitionBy(*by, "_share").orderBy(*order)
    likely = kept.withColumn("_share", share).withColumn("_place", F.row_number().over(within))
    likely = likely.where(F.col("_place") <= top_n).drop("_share", "_place")
    best = Window.partitionBy(*by).orderBy(*order)
    return likely.withColumn("position", F.row_number().over(best)).where(F.col("position") <= top_n)
