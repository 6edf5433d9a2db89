"""Index and position windows over variants, without nested-loop joins.

Index windows hold ``size`` consecutive rows of ``vidx``; a trailing partial window is
dropped. Position windows are inclusive coordinate ranges; the first one that reaches
``stop`` is clamped to it and is the last. Rows are assigned to the windows that hold
them by arithmetic on the row (an explode of at most size / step numbers), so a window
aggregate is one shuffle with map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def index_windows(n: int, size: int, start: int = 0, stop: int | None = None, step: int | None = None) -> list[tuple[int, int]]:
    """(start, stop) of the full-size index windows, stop exclusive."""
    step, stop = step or size, n if stop is None else stop
    return [(a, a + size) for a in range(start, stop - size + 1, step)]


def n_position_windows(size: int, start: int, stop: int, step: int) -> int:
    return 0 if start >= stop else max(0, math.ceil((stop - start - size) / step)) + 1


def position_windows(size: int, start: int, stop: int, step: int | None = None) -> list[tuple[int, int]]:
    """Inclusive (start, stop) of the position windows."""
    step = step or size
    n = n_position_windows(size, start, stop, step)
    return [(start + i * step, stop if i == n - 1 else start + i * step + size - 1) for i in range(n)]


def position_windows_df(spark: SparkSession, size: int, start: int, stop: int, step: int | None = None) -> DataFrame:
    """The same as a DataFrame (w, window_start, window_stop), made on the executors."""
    step = step or size
    n = n_position_windows(size, start, stop, step)
    a = F.lit(start) + F.col("id") * step
    return spark.range(n).select(F.col("id").alias("w"), a.alias("window_start"), F.when(F.col("id") == n - 1, F.lit(stop)).otherwise(a + size - 1).cast("bigint").alias("window_stop"))


def position_bounds(df: DataFrame, pos: str = "pos") -> tuple[int | None, int | None]:
    """First and last position; two numbers."""
    r = df.agg(F.min(pos), F.max(pos)).first()
    return r[0], r[1]


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("bigint")


def assign_position_windows(df: DataFrame, size: int, start: int, stop: int, step: int | None = None, pos: str = "pos") -> DataFrame:
    """Each row once for every window that holds its position, with ``w``."""
    step = step or size
    n = n_position_windows(size, start, stop, step)
    p = F.col(pos).cast("bigint") - start
    low = F.least(F.greatest(F.lit(0).cast("bigint"), _ceil_div(p - (size - 1), step)), F.lit(n - 1).cast("bigint"))
    high = F.least(F.floor(p / F.lit(step)).cast("bigint"), F.lit(n - 1).cast("bigint"))
    inside = df.where(F.col(pos).between(start, stop)) if n else df.where("false")
    out = inside.withColumn("w", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    first = F.lit(start) + F.col("w") * step
    return out.where((F.col(pos) >= first) & (F.col(pos) <= F.when(F.col("w") == n - 1, F.lit(stop)).otherwise(first + size - 1)))


def windowed(df: DataFrame, aggregates: Mapping[str, Column], size: int, start: int | None = None, stop: int | None = None, step: int | None = None, pos: str = "pos") -> DataFrame:
    """Aggregates of each position window, empty windows included: w, window_start, window_stop, n and the aggregates."""
    if start is None or stop is None:
        low, high = position_bounds(df, pos)
        start, stop = (low or 0) if start is None else start, (high or 0) if stop is None else stop
    got = assign_position_windows(df, size, start, stop, step, pos).groupBy("w").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    windows = position_windows_df(df.sparkSession, size, start, stop, step)
    return windows.join(got, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def windowed_count(df: DataFrame, size: int, start: int | None = None, stop: int | None = None, step: int | None = None, pos: str = "pos") -> DataFrame:
    return windowed(df, {}, size, start, stop, step, pos)


def windowed_given(df: DataFrame, aggregates: Mapping[str, Column], windows: DataFrame, pos: str = "pos", bin_size: int = 100_000, merge: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Aggregates of arbitrary inclusive windows (w, window_start, window_stop), by bins of positions.

    Without ``merge`` every row meets every window that holds it. ``merge`` tells how to
    put partial results of each aggregate together (``F.sum`` for sums and counts): a window
    is then made of some ready blocks of ``_FAN ** level`` positions, a number that grows
    with the logarithm of its length.
    """
    if merge is not None:
        got = _by_blocks(df, aggregates, windows, pos, merge)
    else:
        bins = windows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("window_start") / bin_size), F.floor(F.col("window_stop") / bin_size))))
        rows = df.withColumn("bin", F.floor(F.col(pos) / bin_size))
        # the planner knows the size of the windows only, so it would send the bins through the driver
        hit = rows.join(bins.hint("merge"), "bin").where(F.col(pos).between(F.col("window_start"), F.col("window_stop")))
        got = hit.groupBy("w").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    return windows.join(got, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Blocks of a level that make one of the next; a power of two.
_FAN = 8
_BITS = _FAN.bit_length() - 1


def _by_blocks(df: DataFrame, aggregates: Mapping[str, Column], windows: DataFrame, pos: str, merge: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    length = windows.agg(F.max(F.col("window_stop") - F.col("window_start"))).first()[0]
    top = max(0, int(length or 0) + 1).bit_length() // _BITS
    rows = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_block", F.expr(f"shiftright(cast(`{pos}` as bigint), {_BITS} * _level)"))
    blocks = rows.groupBy("_level", "_block").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    first, last = (F.col(c).cast("bigint") for c in ("window_start", "window_stop"))
    nothing = F.array().cast("array<bigint>")
    between = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(nothing)
    parts = []
    for level in range(top + 1):
        # whole blocks from low to high, without those that a block of the next level holds
        (low, high), (up_low, up_high) = ((F.shiftright(first + ((1 << s) - 1), s), F.shiftright(last + 1, s) - 1) for s in (_BITS * level, _BITS * (level + 1)))
        at = between(low, high)
        if level < top:
            at = F.when(up_low <= up_high, F.concat(between(low, up_low * _FAN - 1), between((up_high + 1) * _FAN, high))).otherwise(at)
        parts.append(at)
    cover = windows.select("w", F.posexplode(F.array(*parts)).alias("_level", "_at")).select("w", "_level", F.explode("_at").alias("_block"))
    hit = blocks.join(cover.hint("merge"), ["_level", "_block"])
    return hit.groupBy("w").agg(F.sum("n").alias("n"), *[merge[k](F.col(k)).alias(k) for k in aggregates])


def moving(df: DataFrame, aggregates: Mapping[str, Column], size: int, start: int = 0, stop: int | None = None, step: int | None = None, vidx: str = "vidx") -> DataFrame:
    """Aggregates of each full index window: w and the aggregates."""
    step = step or size
    i = F.col(vidx).cast("bigint") - start
    low = F.greatest(F.lit(0).cast("bigint"), _ceil_div(i - (size - 1), step))
    high = F.floor(i / F.lit(step)).cast("bigint")
    rows = df.where(F.col(vidx) >= start)
    if stop is not None:
        rows = rows.where(F.col(vidx) < stop)
    rows = rows.withColumn("w", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    got = rows.groupBy("w").agg(F.count("*").alias("_rows"), *[c.alias(k) for k, c in aggregates.items()])
    return got.where(F.col("_rows") == size).drop("_rows")


def moving_mean(df: DataFrame, value: str, size: int, **kw) -> DataFrame:
    return moving(df, {"mean": F.avg(value)}, size, **kw)


def moving_std(df: DataFrame, value: str, size: int, **kw) -> DataFrame:
    """Population standard deviation."""
    return moving(df, {"std": F.stddev_pop(value)}, size, **kw)


def moving_midpoint(df: DataFrame, value: str, size: int, vidx: str = "vidx", **kw) -> DataFrame:
    """Mean of a window's first and last value."""
    return moving(df, {"midpoint": (F.min_by(value, vidx) + F.max_by(value, vidx)) / 2}, size, vidx=vidx, **kw)


def accessible_bases(windows: DataFrame, accessible: DataFrame) -> DataFrame:
    """``windows`` with n_bases: those inside the disjoint inclusive intervals (start, stop) of ``accessible``."""
    bins = lambda d, a, b: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / 100_000), F.floor(F.col(b) / 100_000))))
    low = F.greatest(F.col("window_start"), F.col("start"), F.col("bin") * 100_000)
    high = F.least(F.col("window_stop"), F.col("stop"), F.col("bin") * 100_000 + 99_999)
    hit = bins(windows.select("w", "window_start", "window_stop"), "window_start", "window_stop").join(bins(accessible.select("start", "stop"), "start", "stop"), "bin").where(high >= low)
    got = hit.groupBy("w").agg(F.sum(high - low + 1).alias("n_bases"))
    return windows.join(got, "w", "left").withColumn("n_bases", F.coalesce("n_bases", F.lit(0)))


def per_base(windows: DataFrame, value: str, accessible: DataFrame | None = None, out: str = "per_base") -> DataFrame:
    """Value per [accessible] base of the window; NULL where there are none."""
    if accessible is None:
        windows = windows.withColumn("n_bases", F.col("window_stop") - F.col("window_start") + 1)
    else:
        windows = accessible_bases(windows, accessible)
    return windows.withColumn(out, F.try_divide(F.col(value).cast("double"), F.col("n_bases").cast("double")))


def equally_accessible_windows(accessible: DataFrame, size: int) -> DataFrame:
    """Windows that each hold ``size`` accessible bases; a last partial one is dropped.

    Works on intervals: a running sum of their lengths tells which windows begin or end
    in each, so no row a base is made.
    """
    w = Window.orderBy("start")
    rows = accessible.select("start", "stop").withColumn("before", F.coalesce(F.sum(F.col("stop") - F.col("start") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.col("stop") - F.col("start") + 1
    first = F.ceil(F.col("before") / size)
    last = F.floor((F.col("before") + n - 1) / size)
    starts = rows.where(first <= last).select(F.explode(F.sequence(first, last)).alias("w"), "start", "before").select("w", (F.col("start") + F.col("w") * size - F.col("before")).alias("window_start"))
    first = F.ceil((F.col("before") + 1) / size)
    last = F.floor((F.col("before") + n) / size)
    stops = rows.where(first <= last).select(F.explode(F.sequence(first, last)).alias("e"), "start", "before").select((F.col("e") - 1).alias("w"), (F.col("start") + F.col("e") * size - F.col("before") - 1).alias("window_stop"))
    return starts.join(stops, "w")
