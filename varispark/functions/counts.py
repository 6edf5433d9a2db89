"""Column builders over allele counts: ``ac`` is ARRAY<BIGINT>, index = allele.

Undefined values are NULL, never NaN, so sums skip them as the statistics require.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(ac: Column) -> Column:
    """Called alleles."""
    return F.aggregate(ac, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def at(ac: Column, allele: int) -> Column:
    return F.coalesce(F.get(ac, F.lit(allele)), F.lit(0)).cast("bigint")


def to_frequencies(ac: Column) -> Column:
    n = total(ac).cast("double")
    return F.transform(ac, lambda x: F.try_divide(x.cast("double"), n))


def allelism(ac: Column) -> Column:
    return F.size(F.filter(ac, lambda x: x > 0))


def max_allele(ac: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(ac, lambda x, i: F.when(x > 0, i).otherwise(-1))), F.lit(-1))


def is_variant(ac: Column) -> Column:
    return F.exists(F.transform(ac, lambda x, i: (i > 0) & (x > 0)), lambda x: x)


def is_non_variant(ac: Column) -> Column:
    return ~is_variant(ac)


def is_segregating(ac: Column) -> Column:
    return allelism(ac) > 1


def is_non_segregating(ac: Column, allele: int | None = None) -> Column:
    if allele is None:
        return allelism(ac) <= 1
    return (allelism(ac) == 1) & (at(ac, allele) > 0)


def is_singleton(ac: Column, allele: int = 1) -> Column:
    return at(ac, allele) == 1


def is_doubleton(ac: Column, allele: int = 1) -> Column:
    return at(ac, allele) == 2


def is_biallelic(ac: Column) -> Column:
    return allelism(ac) == 2


def is_biallelic_01(ac: Column, min_mac: int | None = None) -> Column:
    out = (allelism(ac) == 2) & (max_allele(ac) == 1)
    return out if min_mac is None else out & (F.least(at(ac, 0), at(ac, 1)) >= min_mac)


def map_alleles(ac: Column, mapping: Column, max_allele_: int) -> Column:
    """Counts moved to their mapped alleles; where two meet, the last one's count stays."""
    moved = F.arrays_zip(ac.alias("c"), mapping.alias("m"))

    def taken(k: int) -> Column:
        last = F.element_at(F.filter(moved, lambda z: z["m"] == k), -1)
        return F.when(F.exists(moved, lambda z: z["m"] == k), last["c"]).otherwise(F.lit(0)).cast("bigint")

    return F.array(*[taken(k) for k in range(max_allele_ + 1)])


def _pairs(x: Column) -> Column:
    return x.cast("double") * (x.cast("double") - 1) / 2


def mean_pairwise_difference(ac: Column, an: Column | None = None) -> Column:
    """Share of pairs of alleles that differ; NULL without pairs."""
    n = total(ac) if an is None else an
    same = F.aggregate(ac, F.lit(0.0), lambda s, x: s + _pairs(x))
    return 1 - F.try_divide(same, _pairs(n))


def mean_pairwise_difference_between(a: Column, b: Column, an: Column | None = None, bn: Column | None = None) -> Column:
    """Share of pairs across two populations that differ; the narrower count array is padded."""
    n = (total(a) if an is None else an).cast("double") * (total(b) if bn is None else bn).cast("double")
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.try_divide(same, n)


def is_fixed_difference(a: Column, b: Column) -> Column:
    """Both populations called, and no allele in common."""
    shared = F.exists(F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0)) > 0) & (F.coalesce(y, F.lit(0)) > 0)), lambda x: x)
    return (total(a) > 0) & (total(b) > 0) & ~shared


def private_alleles(*acs: Column) -> Column:
    """Per allele: found in exactly one of the populations."""
    flags = F.arrays_zip(*[a.alias(f"p{i}") for i, a in enumerate(acs)])
    return F.transform(flags, lambda z: sum((F.when(F.coalesce(z[f"p{i}"], F.lit(0)) > 0, 1).otherwise(0) for i in range(len(acs))), F.lit(0)) == 1)


def create_allele_mapping(ref: Column, alt: Column, alleles: Column) -> Column:
    """For ref and each alt, its index in ``alleles``, or -1; of repeated alleles the last."""
    n = F.size(alleles)
    back = F.reverse(alleles)
    return F.transform(F.concat(F.array(ref), alt), lambda a: F.when(F.array_contains(back, a), n - F.array_position(back, a).cast("int")).otherwise(-1))


# two-allele statistics


def h_hat(ac: Column) -> Column:
    """Unbiased heterozygosity halved: ac0 ac1 / (an (an - 1))."""
    n = (at(ac, 0) + at(ac, 1)).cast("double")
    return F.try_divide(at(ac, 0).cast("double") * at(ac, 1), n * (n - 1))


def alt_frequency(ac: Column) -> Column:
    return F.try_divide(at(ac, 1).cast("double"), (at(ac, 0) + at(ac, 1)).cast("double"))


def _scaled_h(ac: Column) -> Column:
    return F.try_divide(h_hat(ac), (at(ac, 0) + at(ac, 1)).cast("double"))


def patterson_f2(a: Column, b: Column) -> Column:
    d = alt_frequency(a) - alt_frequency(b)
    return d * d - _scaled_h(a) - _scaled_h(b)


def patterson_f3(c: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(T, B): numerator and 2 h of the test population."""
    t = (alt_frequency(c) - alt_frequency(a)) * (alt_frequency(c) - alt_frequency(b)) - _scaled_h(c)
    return t, 2 * h_hat(c)


def patterson_d(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    w, x, y, z = map(alt_frequency, (a, b, c, d))
    return (w - x) * (y - z), (w + x - 2 * w * x) * (y + z - 2 * y * z)


def hudson_fst(a: Column, b: Column) -> tuple[Column, Column]:
    """(numerator, denominator): between minus mean within, and between."""
    within = (mean_pairwise_difference(a) + mean_pairwise_difference(b)) / 2
    between = mean_pairwise_difference_between(a, b)
    return between - within, between


def patterson_fst(a: Column, b: Column) -> tuple[Column, Column]:
    n = patterson_f2(a, b)
    return n, n + h_hat(a) + h_hat(b)


def heterozygosity_expected(ac: Column, ploidy: int) -> Column:
    """1 - sum of frequencies to the power of ploidy; NULL where nothing is called."""
    n = total(ac).cast("double")
    return F.when(n > 0, 1 - F.aggregate(ac, F.lit(0.0), lambda s, x: s + F.pow(F.try_divide(x.cast("double"), n), F.lit(float(ploidy)))))


def harmonic(n: Column, power: int = 1) -> Column:
    """Sum over i from 1 to n - 1 of 1 / i ** power; 0 for n below 2."""
    steps = F.when(n > 1, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1.0 / F.pow(i.cast("double"), F.lit(float(power))))


def pad(ac: Column, width: int) -> Column:
    """Zero columns up to ``width`` alleles."""
    return F.concat(ac, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(width) - F.size(ac))))
