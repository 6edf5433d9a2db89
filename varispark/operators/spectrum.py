"""Site frequency spectra: dense histograms of allele counts, scaled, joint and folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dense(df: DataFrame, keys: dict[str, tuple[Column, int]]) -> DataFrame:
    """Counts for every combination of keys from 0 to their largest value."""
    got = df.groupBy(*[c.alias(k) for k, (c, _) in keys.items()]).agg(F.count("*").alias("count"))
    cells = 1
    for _, n in keys.values():
        cells *= n + 1
    rest, grid = F.col("id"), df.sparkSession.range(cells)
    for k, (_, n) in reversed(keys.items()):
        grid = grid.withColumn(k, rest % (n + 1))
        rest = F.floor(rest / (n + 1))
    return grid.drop("id").join(got, list(keys), "left").withColumn("count", F.coalesce("count", F.lit(0)))


def _size(df: DataFrame, value: Column, n: int | None) -> int:
    m = df.agg(F.max(value)).first()[0] or 0
    if n is not None and n < m:
        raise ValueError(f"n is {n}, but counts reach {m}")
    return m if n is None else n


def sfs(df: DataFrame, dac: str, n: int | None = None) -> DataFrame:
    """(k, count) for k from 0 to n derived alleles."""
    c = F.col(dac).cast("bigint")
    return _dense(df.where(c.isNotNull()), {"k": (c, _size(df, c, n))})


def minor_count(ac: str) -> Column:
    return F.least(F.col(ac)[0], F.col(ac)[1]).cast("bigint")


def _chromosomes(df: DataFrame, ac: str, n: int | None) -> int:
    m = df.agg(F.max(F.aggregate(ac, F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    if n is not None and n < m:
        raise ValueError(f"n is {n}, but rows have {m} alleles")
    return m if n is None else n


def sfs_folded(df: DataFrame, ac: str, n: int | None = None) -> DataFrame:
    """(k, count) for minor allele counts from 0 to n // 2."""
    return _dense(df, {"k": (minor_count(ac), _chromosomes(df, ac, n) // 2)})


def scale_sfs(s: DataFrame) -> DataFrame:
    return s.withColumn("count", F.col("count") * F.col("k"))


def scale_sfs_folded(s: DataFrame, n: int) -> DataFrame:
    return s.withColumn("count", F.col("count") * F.col("k") * (n - F.col("k")) / n)


def sfs_scaled(df: DataFrame, dac: str, n: int | None = None) -> DataFrame:
    return scale_sfs(sfs(df, dac, n))


def sfs_folded_scaled(df: DataFrame, ac: str, n: int | None = None) -> DataFrame:
    m = _chromosomes(df, ac, n)
    return scale_sfs_folded(sfs_folded(df, ac, m), m)


def joint_sfs(df: DataFrame, dac1: str, dac2: str, n1: int | None = None, n2: int | None = None) -> DataFrame:
    """(i, j, count) over both populations' derived allele counts."""
    a, b = F.col(dac1).cast("bigint"), F.col(dac2).cast("bigint")
    return _dense(df, {"i": (a, _size(df, a, n1)), "j": (b, _size(df, b, n2))})


def joint_sfs_folded(df: DataFrame, ac1: str, ac2: str, n1: int | None = None, n2: int | None = None) -> DataFrame:
    return _dense(df, {"i": (minor_count(ac1), _chromosomes(df, ac1, n1) // 2), "j": (minor_count(ac2), _chromosomes(df, ac2, n2) // 2)})


def scale_joint_sfs(s: DataFrame) -> DataFrame:
    return s.withColumn("count", F.col("count") * F.col("i") * F.col("j"))


def scale_joint_sfs_folded(s: DataFrame, n1: int, n2: int) -> DataFrame:
    return s.withColumn("count", F.col("count") * F.col("i") * F.col("j") * (n1 - F.col("i")) * (n2 - F.col("j")))


def joint_sfs_scaled(df: DataFrame, dac1: str, dac2: str, n1: int | None = None, n2: int | None = None) -> DataFrame:
    return scale_joint_sfs(joint_sfs(df, dac1, dac2, n1, n2))


def joint_sfs_folded_scaled(df: DataFrame, ac1: str, ac2: str, n1: int | None = None, n2: int | None = None) -> DataFrame:
    m1, m2 = _chromosomes(df, ac1, n1), _chromosomes(df, ac2, n2)
    return scale_joint_sfs_folded(joint_sfs_folded(df, ac1, ac2, m1, m2), m1, m2)


def _mirror(k: Column, n: int) -> Column:
    half = (n + 1) // 2
    return F.when(k < half, k).when(k < 2 * half, 2 * half - 1 - k)


def fold_sfs(s: DataFrame, n: int) -> DataFrame:
    """Bin k joins its mirror 2h - 1 - k, with h = (n + 1) // 2; for even n the last bin has none and is left out."""
    return s.withColumn("k", _mirror(F.col("k"), n)).where("k is not null").groupBy("k").agg(F.sum("count").alias("count"))


def fold_joint_sfs(s: DataFrame, n1: int, n2: int) -> DataFrame:
    """The same rule on each axis."""
    m = s.withColumn("i", _mirror(F.col("i"), n1)).withColumn("j", _mirror(F.col("j"), n2))
    return m.where("i is not null and j is not null").groupBy("i", "j").agg(F.sum("count").alias("count"))
