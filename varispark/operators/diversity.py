"""Nucleotide diversity, divergence and neutrality over allele counts.

Inputs have ``pos`` and array columns of allele counts; ``accessible`` is a DataFrame of
disjoint inclusive intervals (start, stop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.functions import counts as C
from varispark.operators import windows as W


def mask_inaccessible(df: DataFrame, accessible: DataFrame, pos: str = "pos", bin_size: int = 100_000) -> DataFrame:
    """Rows at accessible positions, by an equi-join on bins of positions."""
    bins = accessible.select("start", "stop", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("stop") / bin_size))).alias("_bin"))
    rows = df.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    on = (rows["_bin"] == bins["_bin"]) & rows[pos].between(bins["start"], bins["stop"])
    return rows.join(bins, on, "left_semi").drop("_bin")


def _within(df: DataFrame, start: int | None, stop: int | None, accessible: DataFrame | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("pos") >= start)
    if stop is not None:
        df = df.where(F.col("pos") <= stop)
    return df if accessible is None else mask_inaccessible(df, accessible)


def _bases(start: int | None, stop: int | None, accessible: DataFrame | None) -> Column:
    """Bases of the range, as a column over the aggregate of ``pos`` (lo, hi)."""
    if accessible is None:
        return (F.coalesce(F.lit(stop), F.col("hi")) - F.coalesce(F.lit(start), F.col("lo")) + 1).cast("double")
    low = F.col("start") if start is None else F.greatest(F.col("start"), F.lit(start))
    high = F.col("stop") if stop is None else F.least(F.col("stop"), F.lit(stop))
    n = accessible.agg(F.sum(F.greatest(F.lit(0), high - low + 1))).first()[0]
    return F.lit(float(n or 0))


def _scalar(df: DataFrame, value: Column, name: str, start, stop, accessible) -> DataFrame:
    rows = _within(df, start, stop, accessible)
    got = rows.agg(F.sum(value).alias("s"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return got.select(F.try_divide(F.col("s"), _bases(start, stop, accessible)).alias(name))


def sequence_diversity(df: DataFrame, ac: str = "ac", start=None, stop=None, accessible=None) -> DataFrame:
    return _scalar(df, C.mean_pairwise_difference(F.col(ac)), "pi", start, stop, accessible)


def sequence_divergence(df: DataFrame, ac1: str, ac2: str, an1: Column | None = None, an2: Column | None = None, start=None, stop=None, accessible=None) -> DataFrame:
    return _scalar(df, C.mean_pairwise_difference_between(F.col(ac1), F.col(ac2), an1, an2), "dxy", start, stop, accessible)


def _windowed_sum(df: DataFrame, value: Column, name: str, size, start, stop, step, accessible) -> DataFrame:
    low, high = W.position_bounds(df) if start is None or stop is None else (start, stop)
    start, stop = (low or 0) if start is None else start, (high or 0) if stop is None else stop
    rows = df if accessible is None else mask_inaccessible(df, accessible)
    got = W.windowed(rows.withColumn("_v", value), {"_s": F.sum("_v")}, size, start, stop, step)
    return W.per_base(got.withColumn("_s", F.coalesce("_s", F.lit(0.0))), "_s", accessible, name).drop("_s")


def windowed_diversity(df: DataFrame, size: int, ac: str = "ac", start=None, stop=None, step=None, accessible=None) -> DataFrame:
    """pi of each window; an empty window with bases has 0."""
    return _windowed_sum(df, C.mean_pairwise_difference(F.col(ac)), "pi", size, start, stop, step, accessible)


def windowed_divergence(df: DataFrame, ac1: str, ac2: str, size: int, start=None, stop=None, step=None, accessible=None) -> DataFrame:
    return _windowed_sum(df, C.mean_pairwise_difference_between(F.col(ac1), F.col(ac2)), "dxy", size, start, stop, step, accessible)


def windowed_df(df: DataFrame, ac1: str, ac2: str, size: int, start=None, stop=None, step=None, accessible=None) -> DataFrame:
    """Density of fixed differences."""
    return _windowed_sum(df, C.is_fixed_difference(F.col(ac1), F.col(ac2)).cast("double"), "df", size, start, stop, step, accessible)


def watterson_theta(df: DataFrame, ac: str = "ac", start=None, stop=None, accessible=None) -> DataFrame:
    """Segregating sites over the harmonic number of one n, the largest allele number of all rows."""
    rows = _within(df, start, stop, accessible)
    got = rows.agg(F.count_if(C.is_segregating(F.col(ac))).alias("s"), F.max(C.total(F.col(ac))).alias("m"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    theta = F.try_divide(F.col("s").cast("double"), C.harmonic(F.col("m")))
    return got.select(F.try_divide(theta, _bases(start, stop, accessible)).alias("theta"))


def max_allele_number(df: DataFrame, ac: str = "ac") -> int:
    """One number for the whole table."""
    return df.agg(F.max(C.total(F.col(ac)))).first()[0] or 0


def windowed_watterson_theta(df: DataFrame, size: int, ac: str = "ac", start=None, stop=None, step=None, accessible=None) -> DataFrame:
    n = max_allele_number(df if accessible is None else mask_inaccessible(df, accessible), ac)
    seg = C.is_segregating(F.col(ac)).cast("double")
    got = _windowed_sum(df, seg, "s", size, start, stop, step, accessible)
    return got.withColumn("theta", F.try_divide(F.col("s"), C.harmonic(F.lit(n)))).drop("s")


def tajima_d_value(s: Column, pi: Column, n: Column, min_sites: int = 3) -> Column:
    """Tajima's D from segregating sites, the sum of pairwise differences and the number of alleles."""
    n = n.cast("double")
    s = s.cast("double")
    a1, a2 = C.harmonic(n), C.harmonic(n, 2)
    b1 = F.try_divide(n + 1, 3 * (n - 1))
    b2 = F.try_divide(2 * (n * n + n + 3), 9 * n * (n - 1))
    c1 = b1 - F.try_divide(F.lit(1.0), a1)
    c2 = b2 - F.try_divide(n + 2, a1 * n) + F.try_divide(a2, a1 * a1)
    e1, e2 = F.try_divide(c1, a1), F.try_divide(c2, a1 * a1 + a2)
    return F.when(s >= min_sites, F.try_divide(pi - F.try_divide(s, a1), F.sqrt(e1 * s + e2 * s * (s - 1))))


def _tajima_parts(ac: str) -> dict[str, Column]:
    return {"_s": F.count_if(C.is_segregating(F.col(ac))), "_pi": F.coalesce(F.sum(C.mean_pairwise_difference(F.col(ac))), F.lit(0.0)), "_n": F.max(C.total(F.col(ac)))}


def tajima_d(df: DataFrame, ac: str = "ac", start=None, stop=None, min_sites: int = 3) -> DataFrame:
    rows = _within(df, start, stop, None) if start is not None or stop is not None else df
    got = rows.agg(*[c.alias(k) for k, c in _tajima_parts(ac).items()])
    return got.select(tajima_d_value(F.col("_s"), F.col("_pi"), F.col("_n"), min_sites).alias("d"))


def windowed_tajima_d(df: DataFrame, size: int, ac: str = "ac", start=None, stop=None, step=None, min_sites: int = 3) -> DataFrame:
    n = max_allele_number(df, ac)
    parts = {k: v for k, v in _tajima_parts(ac).items() if k != "_n"}
    got = W.windowed(df, parts, size, start, stop, step)
    return got.withColumn("d", tajima_d_value(F.coalesce("_s", F.lit(0)), F.coalesce("_pi", F.lit(0.0)), F.lit(n), min_sites)).drop("_s", "_pi")


def moving_tajima_d(df: DataFrame, size: int, ac: str = "ac", start: int = 0, stop=None, step=None, min_sites: int = 3) -> DataFrame:
    """D of index windows; n is each window's own."""
    got = W.moving(df, _tajima_parts(ac), size, start, stop, step)
    return got.select("w", tajima_d_value(F.col("_s"), F.col("_pi"), F.col("_n"), min_sites).alias("d"))


def moving_delta_tajima_d(df: DataFrame, ac1: str, ac2: str, size: int, start: int = 0, stop=None, step=None) -> DataFrame:
    """Standardised difference of two populations' D; one undefined window leaves all undefined."""
    a = moving_tajima_d(df, size, ac1, start, stop, step).withColumnRenamed("d", "d1")
    b = moving_tajima_d(df, size, ac2, start, stop, step).withColumnRenamed("d", "d2")
    both = a.join(b, "w").withColumn("delta", F.col("d1") - F.col("d2"))
    stats = both.agg(F.avg("delta").alias("m"), F.stddev_pop("delta").alias("sd"), F.count_if(F.col("delta").isNull()).alias("gaps"))
    return both.crossJoin(F.broadcast(stats)).select("w", F.when(F.col("gaps") == 0, F.try_divide(F.col("delta") - F.col("m"), F.col("sd"))).alias("delta"))
