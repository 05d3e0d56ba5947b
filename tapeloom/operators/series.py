"""Ordered computation over keyed series without ever needing one task per key.

A series with a declared step holds at most one row per key and step, so the calendar
bounds it and a plain window per key is safe: a century has 36,500 days, and 6 million
minutes at 240 a day, which one task sorts within its memory or by spilling.  This follows
from the declaration, never from a count of rows.  A series without a step (fills, ticks),
or one that asks for ``cuts``, is cut by range, at every size:

* ``repartitionByRange`` on keys, order and a hash of the row gives partitions of about equal
  size that are runs of rows in order; a position numbers the rows of each run, and (key,
  partition) is the block,
* a key lies in several blocks only where a boundary between partitions cuts it, so at most
  twice as many blocks as there are partitions need more than their own rows; one summary
  row for each of them is broadcast,
* the last ``lookback`` rows before a block are also copied into it as a halo, so rolling
  frames inside the block see their whole history,
* unbounded frames and exponential averages take a carry, computed from the summary rows.

Rows move twice, once by range and once by block, and are read once: the cut refers to every
column, so all passes over it share the same exchange.  The second move gives each range a
task of its own, so a task holds the rows of one range: none share it by the chance of a
hash, and adaptive execution does not merge them up to a share of all rows.  Positions are compared with the
summary, and a pass that was cut elsewhere fails instead of giving another result.

The result is the same as with one window per key, whatever the share of a hot key.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.expr import as_col

BLOCK, OWN, AT = "_block", "_own", "_at"


@dataclass(frozen=True)
class Series:
    """Identity of a family of ordered series.

    ``step`` is the bar interval and declares one row per key and step at most.  A series
    without it is cut into ``cuts`` ranges, by default as many as there are shuffle partitions,
    or more for very many rows; one with a step is cut only if ``cuts`` is given.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("timestamp",)
    step: str | None = "1d"
    cuts: int | None = None

    @property
    def bounded(self) -> bool:
        return self.step is not None and self.cuts is None

    def by(self, keys: Sequence[str]) -> Series:
        return replace(self, keys=tuple(keys))

    def position(self) -> Column:
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)


DAILY = Series()
MINUTE = Series(step="1m")


@dataclass(frozen=True)
class Layout:
    """A frame ready for windows: ``parts`` partition it, ``order`` sorts it."""

    df: DataFrame
    series: Series
    parts: tuple[str, ...]

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.series.order)

    def tail(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)

    def rolling(self, agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
        """``agg`` over the last ``n`` rows, NULL until all ``n`` values are present."""
        value, frame = as_col(x), self.tail(n)
        return F.when(F.count(value).over(frame) == n, agg(value).over(frame))

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(as_col(x), n).over(self.rows)

    def with_levels(self, levels: list[dict[str, Column]]) -> Layout:
        df = self.df
        for level in levels:
            if level:
                df = df.withColumns(level)
        return replace(self, df=df)

    @property
    def whole(self) -> bool:
        """True when every partition holds a complete series, so there is no halo or carry."""
        return self.parts == self.series.keys

    def own(self) -> Layout:
        """Without the halo rows."""
        return self if self.whole else replace(self, df=self.df.where(F.col(OWN)))


#: Rows of a range, beyond which there are more ranges than shuffle partitions.
ROWS_PER_RANGE = 250_000


def _ranges(df: DataFrame, series: Series) -> int:
    """As many as shuffle partitions, and more where a task would hold too many rows.

    The rows are counted beforehand, so that a task does not grow with the input.
    """
    if series.cuts:
        return series.cuts
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, math.ceil(df.count() / ROWS_PER_RANGE))


def _placed(df: DataFrame, series: Series, ranges: int) -> DataFrame:
    """``df`` cut by range, with block, position and the mark of rows in their own block.

    The number of ranges is given, so that adaptive execution does not merge some of them.
    The hash makes the order total and keeps every column below the exchange.
    """
    order = [*series.keys, *series.order, F.xxhash64(*df.columns)]
    cut = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The upper bits of the id are the partition, the lower ones count its rows.
    return cut.withColumn(AT, F.monotonically_increasing_id()).withColumns(
        {BLOCK: F.shiftrightunsigned(AT, 33).cast("int"), OWN: F.lit(True)}
    )


def _dealt(df: DataFrame, ranges: int) -> DataFrame:
    """Every block in the partition of its number, which windows by keys and block accept."""
    return df.repartitionById(ranges, BLOCK)


def _shared(df: DataFrame, series: Series, *totals: Column) -> DataFrame:
    """One row per block of the keys that lie in several blocks: rows, first position, ``totals``.

    Two neighbours share at most one key, so there are at most twice as many rows as ranges.
    """
    blocks = df.groupBy(*series.keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_block_n"), F.min(AT).alias("_block_from"), *totals
    )
    several = F.count(F.lit(1)).over(Window.partitionBy(*series.keys))
    return blocks.withColumn("_block_several", several).where(F.col("_block_several") > 1).drop("_block_several")


def _with_shared(df: DataFrame, series: Series, blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns ``names`` of rows of ``_shared``, NULL where a key lies in one block."""
    own = {c: f"_block_of{i}" for i, c in enumerate((*series.keys, BLOCK))}
    right = blocks.select("_block_n", "_block_from", *names, *[F.col(c).alias(n) for c, n in own.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in own.items()])
    out = df.join(F.broadcast(right), same, "left")
    elsewhere = F.col(OWN) & ((F.col(AT) < F.col("_block_from")) | (F.col(AT) >= F.col("_block_from") + F.col("_block_n")))
    failed = F.raise_error(F.lit("two passes over a series were cut at different rows"))
    values = {name: F.when(elsewhere, failed).otherwise(F.col(name)) for name in names}
    return out.withColumns(values).drop("_block_n", "_block_from", *own.values())


def lay_out(df: DataFrame, series: Series, lookback: int = 0) -> Layout:
    """Partition ``df`` so that every row sees ``lookback`` earlier rows of its series."""
    if series.bounded:
        return Layout(df, series, series.keys)
    ranges = _ranges(df, series)
    placed = _placed(df, series, ranges)
    parts = (*series.keys, BLOCK)
    if not lookback:
        return Layout(_dealt(placed, ranges), series, parts)
    blocks = Window.partitionBy(*series.keys).orderBy(BLOCK)
    upto = F.sum("_block_n").over(blocks.rowsBetween(Window.unboundedPreceding, 0))
    # A block has a row at least, so no more than ``lookback`` blocks can need its rows.
    behind = F.collect_list(F.struct(F.col(BLOCK).alias("block"), (F.col("_block_upto") - F.col("_block_n")).alias("before")))
    ends = (
        _shared(placed, series)
        .withColumn("_block_upto", upto)
        .withColumn("_block_later", behind.over(blocks.rowsBetween(1, lookback)))
        .withColumn("_block_end", F.col("_block_from") + F.col("_block_n"))
    )
    joined = _with_shared(placed, series, ends, ("_block_upto", "_block_later", "_block_end"))
    # Rows of the series from this one to the end of the block before, this one included.
    near = F.filter("_block_later", lambda b: F.col("_block_end") - F.col(AT) + b["before"] - F.col("_block_upto") <= lookback)
    into = F.concat(F.array(BLOCK), F.coalesce(F.transform(near, lambda b: b["block"]), F.array().cast("array<int>")))
    copied = (
        joined.withColumns({"_block_home": F.col(BLOCK), "_block_into": into})
        .withColumn(BLOCK, F.explode("_block_into"))
        .withColumn(OWN, F.col(BLOCK) == F.col("_block_home"))
        .drop("_block_home", "_block_into", "_block_upto", "_block_later", "_block_end")
    )
    return Layout(_dealt(copied, ranges), series, parts)


Scan = tuple[str, Column]

_INNER: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def running(layout: Layout, scans: Mapping[str, Scan]) -> Layout:
    """Add running aggregates (``sum product max first last``) over whole series.

    ``first``/``last`` skip NULLs, i.e. ``last`` is a forward fill.  Halo rows are dropped.
    """
    if not scans:
        return layout.own()
    base = layout.own()
    frame = base.rows.rowsBetween(Window.unboundedPreceding, 0)
    local = {name: _INNER[kind](expr).over(frame) for name, (kind, expr) in scans.items()}
    if base.whole:
        return replace(base, df=base.df.withColumns(local))

    position = base.series.position()

    def total(kind: str, expr: Column) -> Column:
        if kind == "first":
            return F.min_by(expr, F.when(expr.isNotNull(), position))
        if kind == "last":
            return F.max_by(expr, F.when(expr.isNotNull(), position))
        return _INNER[kind](expr)

    before = (
        Window.partitionBy(*base.series.keys)
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = {name: f"_carry_{name}" for name in scans}
    totals = _shared(
        base.df, base.series, *[total(kind, expr).alias(carries[name]) for name, (kind, expr) in scans.items()]
    ).withColumns({carries[n]: _INNER[kind](F.col(carries[n])).over(before) for n, (kind, _) in scans.items()})

    def join_up(name: str, kind: str) -> Column:
        here, carry = F.col(name), F.col(carries[name])
        if kind == "sum":
            return F.coalesce(carry + here, here, carry)
        if kind == "product":
            return F.coalesce(carry * here, here, carry)
        if kind == "max":
            return F.greatest(carry, here)
        return F.coalesce(carry, here) if kind == "first" else F.coalesce(here, carry)

    joined = _with_shared(base.df.withColumns(local), base.series, totals, list(carries.values()))
    joined = joined.withColumns({n: join_up(n, kind) for n, (kind, _) in scans.items()})
    return replace(base, df=joined.drop(*carries.values()))


def _stretch_rows(alpha: float) -> int:
    """Rows over which the weight of a value falls to e**-300, so that sums scaled by it fit a double."""
    return max(1, math.floor(300 / -math.log1p(-alpha)))


def _average_levels(layout: Layout, name: str, x: Column, alpha: float, seed: Column) -> list[dict[str, Column]]:
    """Levels that add ``name`` = e(t) = (1-alpha) e(t-1) + seed x(t), e before the partition = 0.

    Inside a stretch the recursion is the framed sum of x q**-j scaled by q**j.  A stretch
    hands on its last value with what it was handed itself; three stretches back a weight is
    e**-900, which is 0 as a double.
    """
    q, span = 1.0 - alpha, _stretch_rows(alpha)
    local, ahead, further = (f"{name}_{s}" for s in ("loc", "ahd", "fur"))
    index = F.col("_row") - 1
    inside = (
        Window.partitionBy(*layout.parts, F.floor(index / span))
        .orderBy(*layout.series.order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = layout.rows.rowsBetween(Window.unboundedPreceding, -1)
    power = F.pow(F.lit(q), index % span)

    def handed(value: Column) -> Column:
        closing = F.when(index % span == span - 1, value)
        return F.coalesce(F.last(closing, ignorenulls=True).over(earlier), F.lit(0.0))

    whole = F.lit(q**span)
    return [
        {local: power * F.sum(seed * x / power).over(inside)},
        {ahead: handed(F.col(local))},
        {further: handed(F.col(local) + whole * F.col(ahead))},
        {f"{further}2": handed(F.col(local) + whole * F.col(further))},
        {name: F.col(local) + F.col(f"{further}2") * power * q},
    ]


def averaged(layout: Layout, averages: Mapping[str, tuple[Column, float]]) -> Layout:
    """Add exponential averages ``name: (x, alpha)`` over whole series, seeded by the first value.

    A block starts from 0 and is given what the block before it ends with, decayed row by
    row; the ends follow from one pair (decay, local end) per block.  The first block of a
    key is given the first value, which is the same as seeding with it.  Halo rows are dropped.
    """
    if not averages:
        return layout.own()
    base = layout.own()
    columns = base.df.columns
    moving = {name: spec for name, spec in averages.items() if spec[1] < 1}
    lay = base.with_levels([{name: x for name, (x, alpha) in averages.items() if alpha >= 1}])
    if not moving:
        return lay
    lay = lay.with_levels([{"_row": F.row_number().over(base.rows)}])
    first = F.col("_row") == 1 if base.whole else F.lit(False)
    chains = [
        _average_levels(base, name, x, alpha, F.when(first, F.lit(1.0)).otherwise(F.lit(alpha)))
        for name, (x, alpha) in moving.items()
    ]
    for depth in zip(*chains):
        lay = lay.with_levels([{k: v for level in depth for k, v in level.items()}])
    if base.whole:
        return replace(lay, df=lay.df.select(*columns, *averages))
    keys, position = base.series.keys, base.series.position()
    starts = {f"_start_{name}": F.first(x).over(base.rows) for name, (x, _) in moving.items()}
    inner = lay.with_levels([starts]).df.select(*columns, "_row", *averages, *starts)
    ends = _shared(
        inner,
        base.series,
        *[F.max_by(name, position).alias(f"_end_{name}") for name in moving],
        *[F.min_by(start, position).alias(start) for start in starts],
    )
    previous = Window.partitionBy(*keys).orderBy(BLOCK)
    ends = ends.withColumn("_opens", F.row_number().over(previous) == 1)
    carries = {}
    for name, (_, alpha) in moving.items():
        decay = F.pow(F.lit(1.0 - alpha), F.col("_block_n"))
        seeded = F.when(F.col("_opens"), decay * F.coalesce(f"_start_{name}", F.lit(0.0))).otherwise(F.lit(0.0))
        ends = ends.withColumn(f"_end_{name}", F.col(f"_end_{name}") + seeded)
        for level in _blend_levels(keys, (BLOCK,), f"_all_{name}", decay, F.col(f"_end_{name}")):
            ends = ends.withColumns(level)
        carries[f"_carry_{name}"] = F.when(~F.col("_opens"), F.coalesce(F.lag(f"_all_{name}").over(previous), F.lit(0.0)))
    joined = _with_shared(inner, base.series, ends.withColumns(carries), list(carries))
    exact = {
        name: F.col(name)
        + F.pow(F.lit(1.0 - alpha), F.col("_row")) * F.coalesce(f"_carry_{name}", f"_start_{name}", F.lit(0.0))
        for name, (_, alpha) in moving.items()
    }
    return replace(base, df=joined.withColumns(exact).select(*columns, *averages))


BAND = 300.0


def _blend_levels(
    parts: tuple[str, ...], order: tuple[str, ...], name: str, a: Column, b: Column, depth: int = 3
) -> list[dict[str, Column]]:
    """Levels for ``name`` = e(t) = a(t) e(t-1) + b(t), 0 <= a <= 1, e before the start = 0.

    Log-decay is cut into bands of e**-300; a band hands its last value to the next and
    a(t) = 0 starts afresh.  ``{name}_kept`` is the product of a since the start.  ``depth``
    bands back are handed on.

    Resets and bands never fall, so the windows after them order by both first: it is the
    same order, and the one that the rows are sorted in already.
    """
    reset, decay, band, local = (f"{name}_{s}" for s in ("reset", "decay", "band", "loc"))
    rows = Window.partitionBy(*parts).orderBy(*order)
    upto = (Window.unboundedPreceding, 0)
    episode = Window.partitionBy(*parts, reset).orderBy(*order)
    strip = Window.partitionBy(*parts, reset, band).orderBy(*order)
    strips = Window.partitionBy(*parts).orderBy(reset, band, *order)
    offset = F.col(decay) + BAND * F.col(band)
    ends = F.lead(F.struct(reset, band)).over(strips) != F.struct(reset, band)

    def with_handed(value: Column, end: str) -> Column:
        """The local part and what the band before ended with, ``value`` being its end."""
        before = F.last(end, ignorenulls=True).over(strips.rowsBetween(Window.unboundedPreceding, -1))
        same = before[reset] == F.col(reset)
        return value + F.coalesce(F.when(same, F.exp(F.col(decay) - before[decay]) * before["v"]), F.lit(0.0))

    levels = [
        {reset: F.sum(F.when(a <= 0, 1).otherwise(0)).over(rows.rowsBetween(*upto))},
        {decay: F.sum(F.when(a > 0, F.log(a)).otherwise(0.0)).over(episode.rowsBetween(*upto))},
        {band: F.floor(-F.col(decay) / BAND)},
        {local: F.exp(offset) * F.sum(b * F.exp(-offset)).over(strip.rowsBetween(*upto))},
    ]
    # Three bands back a weight is below e**-600 times a band's own; one more is 0 as a double.
    full = F.col(local)
    for step in range(depth):
        end = f"{name}_end{step}"
        levels.append({end: F.when(ends, F.struct(reset, decay, full.alias("v")))})
        levels.append({f"{name}_full{step}": with_handed(F.col(local), end)})
        full = F.col(f"{name}_full{step}")
    kept = F.when(F.col(reset) > 0, F.lit(0.0)).otherwise(F.exp(decay))
    return [*levels, {name: full, f"{name}_kept": kept}]


def blended(layout: Layout, name: str, weight: Column, x: Column) -> Layout:
    """Add ``name`` = e(t) = (1-weight) e(t-1) + weight x(t), 0 <= weight <= 1, over whole series.

    The weights of all earlier values add up to 1, so what lies two bands of decay back is
    below e**-300 of it and one band is handed on; values of one sign and of like size are meant.

    Blocks are summarised by one (a, b) pair each and scanned by the same recursion, so a
    series of any length needs no task larger than a block.  Halo rows are dropped.
    """
    base, columns = layout.own(), layout.df.columns
    order, kept = base.series.order, f"{name}_kept"
    inner = base.with_levels(_blend_levels(base.parts, order, name, 1 - weight, weight * x, 1))
    if base.whole:
        return replace(base, df=inner.df.select(*columns, name))
    keys, position = base.series.keys, base.series.position()
    inner = replace(base, df=inner.df.select(*columns, name, kept))
    blocks = _shared(
        inner.df, base.series, F.max_by(name, position).alias("_b"), F.max_by(kept, position).alias("_a")
    )
    for level in _blend_levels(keys, (BLOCK,), "_all", F.col("_a"), F.col("_b"), 1):
        blocks = blocks.withColumns(level)
    previous = F.lag("_all").over(Window.partitionBy(*keys).orderBy(BLOCK))
    joined = _with_shared(inner.df, base.series, blocks.withColumn("_carry", previous), ["_carry"])
    joined = joined.withColumn(name, F.col(name) + F.col(kept) * F.coalesce("_carry", F.lit(0.0)))
    return replace(base, df=joined.select(*columns, name))
