"""Genotype tables: selection by variant and sample, counts on either axis, layouts.

Wide layout: a row per variant (vidx, gt, ...). Long layout: a row per allele (vidx,
sidx, pidx, allele). Counts per variant are row-local; counts per sample explode and
aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.functions import calls


def to_long(df: DataFrame, gt: str = "gt") -> DataFrame:
    per_sample = df.select("vidx", F.posexplode(gt).alias("sidx", "g"))
    return per_sample.select("vidx", "sidx", F.posexplode("g").alias("pidx", "allele"))


def to_wide(long: DataFrame, gt: str = "gt") -> DataFrame:
    g = long.groupBy("vidx", "sidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pidx", "allele"))), lambda x: x["allele"]).alias("g"))
    return g.groupBy("vidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sidx", "g"))), lambda x: x["g"]).alias(gt))


def count_per_variant(df: DataFrame, flags: Column, name: str = "n") -> DataFrame:
    """Axis 1: how many calls of each variant have the property."""
    return df.select("vidx", calls.count_true(flags).alias(name))


def count_per_sample(df: DataFrame, flags: Column, name: str = "n") -> DataFrame:
    """Axis 0: how many variants of each sample have the property."""
    return df.select(F.posexplode(flags).alias("sidx", "f")).groupBy("sidx").agg(F.count_if("f").alias(name))


def count_total(df: DataFrame, flags: Column, name: str = "n") -> DataFrame:
    return df.agg(F.coalesce(F.sum(calls.count_true(flags)), F.lit(0)).alias(name))


def compress_variants(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def compress_samples(df: DataFrame, keep: Sequence[bool], columns: Sequence[str] = ("gt",)) -> DataFrame:
    """Samples whose flag is true; the flags must be as many as the samples."""
    flags = F.array(*[F.lit(bool(k)) for k in keep])
    for c in columns:
        checked = F.when(F.size(c) != len(keep), F.raise_error(F.lit("condition and samples differ in length")).cast(df.schema[c].dataType)).otherwise(F.col(c))
        df = df.withColumn(c, F.filter(checked, lambda g, i: flags[i]))
    return df


def take_samples(df: DataFrame, indices: Sequence[int], columns: Sequence[str] = ("gt",)) -> DataFrame:
    at = F.array(*[F.lit(int(i)) for i in indices])
    return df.withColumns({c: _gather(F.col(c), at) for c in columns})


def _gather(values: Column, at: Column) -> Column:
    return F.transform(at, lambda i: values[i])


def take_variants(df: DataFrame, indices: DataFrame | Sequence[int]) -> DataFrame:
    """Rows by vidx, in the given order, repeats included; vidx is numbered anew."""
    if not isinstance(indices, DataFrame):
        indices = df.sparkSession.createDataFrame([(o, int(i)) for o, i in enumerate(indices)], "ordinal bigint, vidx bigint")
    return indices.join(df, "vidx").drop("vidx").withColumnRenamed("ordinal", "vidx")


def subset(df: DataFrame, variants: Sequence[int] | None = None, samples: Sequence[int] | None = None) -> DataFrame:
    out = df if samples is None else take_samples(df, samples)
    return out if variants is None else take_variants(out, variants)


def concatenate_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    n = (a.agg(F.max("vidx")).first()[0] if a.columns else None)
    return a.unionByName(b.withColumn("vidx", F.col("vidx") + (0 if n is None else n + 1)))


def concatenate_samples(a: DataFrame, b: DataFrame, column: str = "gt") -> DataFrame:
    right = b.select("vidx", F.col(column).alias("_right"))
    return a.join(right, "vidx").withColumn(column, F.concat(column, "_right")).drop("_right")


def max_allele(df: DataFrame, gt: str = "gt") -> int:
    return df.agg(F.max(F.array_max(F.flatten(gt)))).first()[0] or 0


def count_alleles(df: DataFrame, max_allele_: int | None = None, subpop: Sequence[int] | None = None, gt: str = "gt", mask: str | None = None, ploidy: int = 2) -> DataFrame:
    """vidx, ac over all samples or a list of them."""
    k = max_allele(df, gt) if max_allele_ is None else max_allele_
    g = F.col(gt) if mask is None else calls.fill_masked(F.col(gt), F.col(mask))
    select = None if subpop is None else calls.sample_to_haplotype_selection(subpop, ploidy)
    return df.select("vidx", calls.count_alleles(F.flatten(g), k, select).alias("ac"))


def count_alleles_subpops(df: DataFrame, subpops: Mapping[str, Sequence[int]], max_allele_: int | None = None, gt: str = "gt", ploidy: int = 2) -> DataFrame:
    """vidx and ac_<name> of every population, in one pass."""
    k = max_allele(df, gt) if max_allele_ is None else max_allele_
    h = F.flatten(gt)
    return df.select("vidx", *[calls.count_alleles(h, k, calls.sample_to_haplotype_selection(s, ploidy)).alias(f"ac_{n}") for n, s in subpops.items()])


def to_sparse(df: DataFrame, h: str = "h") -> DataFrame:
    """Coordinates of non-reference alleles: vidx, hidx, allele."""
    return df.select("vidx", F.posexplode(h).alias("hidx", "allele")).where("allele <> 0")


def from_sparse(coo: DataFrame, n_variants: int, n_haplotypes: int) -> DataFrame:
    """Dense haplotypes (vidx, h) from coordinates."""
    m = coo.groupBy("vidx").agg(F.map_from_entries(F.collect_list(F.struct("hidx", "allele"))).alias("m"))
    rows = coo.sparkSession.range(n_variants).withColumnRenamed("id", "vidx").join(m, "vidx", "left")
    return rows.select("vidx", F.transform(F.sequence(F.lit(0), F.lit(n_haplotypes - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("tinyint")).alias("h"))


def heterozygosity_observed(df: DataFrame, gt: str = "gt") -> DataFrame:
    g = F.col(gt)
    return df.select("vidx", F.try_divide(calls.count_true(calls.is_het(g)).cast("double"), calls.count_true(calls.is_called(g)).cast("double")).alias("ho"))


def inbreeding_coefficient(df: DataFrame, max_allele_: int, gt: str = "gt", ploidy: int = 2) -> DataFrame:
    from varispark.functions.counts import heterozygosity_expected

    g = F.col(gt)
    ho = F.try_divide(calls.count_true(calls.is_het(g)).cast("double"), calls.count_true(calls.is_called(g)).cast("double"))
    he = heterozygosity_expected(calls.count_alleles(F.flatten(g), max_allele_), ploidy)
    return df.select("vidx", F.when(he > 0, 1 - F.try_divide(ho, he)).alias("f"))


def map_blocks(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Apply ``f`` to pandas blocks of rows."""
    return df.mapInPandas(lambda batches: map(f, batches), schema)
