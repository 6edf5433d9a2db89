"""Key lookup, semi-joins and interval joins: what sorted and unique indexes do, as DataFrame joins.

A strict lookup raises KeyError after one check for absent keys; everything else is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def is_sorted(df: DataFrame, key: str, vidx: str = "vidx") -> bool:
    """Whether keys never fall along vidx; compares range-partitioned neighbours."""
    w = Window.partitionBy(F.floor(F.col(vidx) / 100_000)).orderBy(vidx)
    inner = df.withColumn("_p", F.lag(key).over(w)).where(F.col("_p") > F.col(key))
    if not inner.isEmpty():
        return False
    edges = df.groupBy(F.floor(F.col(vidx) / 100_000).alias("b")).agg(F.min_by(key, vidx).alias("lo"), F.max_by(key, vidx).alias("hi"))
    return edges.alias("x").join(edges.alias("y"), F.col("x.b") + 1 == F.col("y.b")).where("x.hi > y.lo").isEmpty()


def is_unique(df: DataFrame, *keys: str) -> bool:
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def set_index(df: DataFrame, *keys: str, unique: bool = False, vidx: str = "vidx") -> DataFrame:
    """``df`` with ``index``, a struct of the keys by which rows are looked up; ValueError if it falls along vidx, or repeats where it must not.

    With two keys, such as chromosome and position, the first one need only come in runs.
    """
    out = df.withColumn("index", F.struct(*keys))
    if len(keys) == 1:
        if not is_sorted(df, keys[0], vidx):
            raise ValueError(f"{keys[0]} is not sorted")
    else:
        first, rest = keys[0], F.struct(*keys[1:])
        here = df.select(F.col(vidx).alias("_v"), F.col(first).alias("_a"), rest.alias("_r"))
        after = here.select((F.col("_v") - 1).alias("_v"), F.col("_a").alias("_b"), F.col("_r").alias("_s"))
        near = here.join(after, "_v")
        if not near.where((F.col("_a") == F.col("_b")) & (F.col("_r") > F.col("_s"))).isEmpty():
            raise ValueError(f"{', '.join(keys[1:])} not sorted within {first}")
        # a value of the first key that begins twice is not one run; one row a run
        starts = near.where(F.col("_a") != F.col("_b")).select(F.col("_b").alias("k")).unionByName(here.where(F.col("_v") == 0).select(F.col("_a").alias("k")))
        if not is_unique(starts, "k"):
            raise ValueError(f"values of {first} come apart")
    if unique and not is_unique(df, *keys):
        raise ValueError("index is not unique")
    return out


def locate_key(df: DataFrame, **keys) -> DataFrame:
    """Rows with these key values, e.g. chrom and pos; KeyError if there are none."""
    out = df
    for k, v in keys.items():
        out = out.where(F.col(k) == v)
    if out.isEmpty():
        raise KeyError(keys)
    return out


def locate_intersection(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``found``: whether the other one has the key."""
    flag = lambda x, y: x.join(y.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return flag(a, b), flag(b, a)


def locate_keys(df: DataFrame, keys: DataFrame, key: str, strict: bool = True) -> DataFrame:
    if strict and not keys.select(key).join(df.select(key), key, "left_anti").isEmpty():
        raise KeyError(f"keys of {key} are absent")
    return locate_intersection(df, keys, key)[0]


def intersect(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other has; repeats stay."""
    return df.join(other.select(key), key, "left_semi")


def locate_range(df: DataFrame, key: str, start=None, stop=None, strict: bool = True, **level1) -> DataFrame:
    """Rows with start <= key <= stop [and the level-1 keys]; open bounds are honoured."""
    out = df
    for k, v in level1.items():
        out = out.where(F.col(k) == v)
    if start is not None:
        out = out.where(F.col(key) >= start)
    if stop is not None:
        out = out.where(F.col(key) <= stop)
    if strict and out.isEmpty():
        raise KeyError((level1, start, stop))
    return out


def intersect_range(df: DataFrame, key: str, start=None, stop=None) -> DataFrame:
    return locate_range(df, key, start, stop, strict=False)


def interval_join(df: DataFrame, ranges: DataFrame, key: str, how: str = "inner", bin_size: int = 100_000) -> DataFrame:
    """Rows and the inclusive ranges (start, stop) that hold their key, through an equi-join on bins."""
    bins = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("stop") / bin_size))))
    rows = df.withColumn("_bin", F.floor(F.col(key) / bin_size))
    on = (rows["_bin"] == bins["_bin"]) & rows[key].between(bins["start"], bins["stop"])
    out = rows.join(bins, on, how)
    return out.drop("_bin") if how.startswith("left_") else out.drop(rows["_bin"]).drop(bins["_bin"])


def locate_intersection_ranges(df: DataFrame, ranges: DataFrame, key: str, bin_size: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Rows in any range, and ranges that hold any row."""
    rows = interval_join(df, ranges, key, "left_semi", bin_size)
    hit = interval_join(df.select(key), ranges, key, "inner", bin_size).select("start", "stop").distinct()
    return rows, ranges.join(hit, ["start", "stop"], "left_semi")


def locate_ranges(df: DataFrame, ranges: DataFrame, key: str, strict: bool = True, bin_size: int = 100_000) -> DataFrame:
    rows, hit = locate_intersection_ranges(df, ranges, key, bin_size)
    if strict and not ranges.join(hit, ["start", "stop"], "left_anti").isEmpty():
        raise KeyError("ranges without rows")
    return rows


def intersect_ranges(df: DataFrame, ranges: DataFrame, key: str, bin_size: int = 100_000) -> DataFrame:
    return interval_join(df, ranges, key, "left_semi", bin_size)


def interval_union(features: DataFrame, start: str = "start", stop: str = "end", by: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint inclusive intervals that cover the same bases, of each group of ``by``."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = features.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    rows = rows.withColumn("_i", F.sum("_new").over(w))
    return rows.groupBy(*by, "_i").agg(F.min(start).alias("start"), F.max(stop).alias("stop")).drop("_i")
