"""Column builders over genotype calls.

A row is a variant. ``gt`` is ARRAY<ARRAY<TINYINT>> (sample, then ploidy), ``h`` is
ARRAY<TINYINT> (haplotypes). A negative allele is missing. ``mask`` is an optional
ARRAY<BOOLEAN>: a masked call counts as missing and as neither hom nor het. All
builders are row-local expressions: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _times(alleles: Column, k: int) -> Column:
    """How often an array has allele k."""
    return F.size(F.filter(alleles, lambda a: a == k))


def _each(gt: Column, f: Callable[[Column], Column], mask: Column | None, masked: bool) -> Column:
    if mask is None:
        return F.transform(gt, f)
    return F.zip_with(gt, mask, lambda g, m: F.when(m, F.lit(masked)).otherwise(f(g)))


def _all_called(g: Column) -> Column:
    return F.forall(g, lambda a: a >= 0)


def is_called(gt: Column, mask: Column | None = None) -> Column:
    """Per call: every allele known, and not masked."""
    return _each(gt, _all_called, mask, False)


def is_missing(gt: Column, mask: Column | None = None) -> Column:
    """Per call: any allele unknown, or masked."""
    return _each(gt, lambda g: F.exists(g, lambda a: a < 0), mask, True)


def is_hom(gt: Column, allele: int | None = None, mask: Column | None = None) -> Column:
    """Per call: all alleles equal and known, or all equal to ``allele``."""
    if allele is not None:
        return _each(gt, lambda g: F.forall(g, lambda a: a == allele), mask, False)
    return _each(gt, lambda g: (g[0] >= 0) & F.forall(g, lambda a: a == g[0]), mask, False)


def is_hom_ref(gt: Column, mask: Column | None = None) -> Column:
    return is_hom(gt, 0, mask)


def is_hom_alt(gt: Column, mask: Column | None = None) -> Column:
    return _each(gt, lambda g: (g[0] > 0) & F.forall(g, lambda a: a == g[0]), mask, False)


def is_het(gt: Column, allele: int | None = None, mask: Column | None = None) -> Column:
    """Per call: fully called with two alleles or more [one of them ``allele``]."""

    def het(g: Column) -> Column:
        out = _all_called(g) & F.exists(g, lambda a: a != g[0])
        return out if allele is None else out & F.exists(g, lambda a: a == allele)

    return _each(gt, het, mask, False)


def is_call(gt: Column, call: Sequence[int], mask: Column | None = None) -> Column:
    """Per call: exactly these alleles, in this order."""
    want = list(call)
    return _each(gt, lambda g: (F.size(g) == len(want)) & F.forall(F.transform(g, lambda a, i: a == F.array(*map(F.lit, want))[i]), lambda x: x), mask, False)


def count_true(flags: Column) -> Column:
    """How many of an array of booleans hold."""
    return F.size(F.filter(flags, lambda x: x)).cast("bigint")


def fill_masked(gt: Column, mask: Column, value: int = -1) -> Column:
    return F.zip_with(gt, mask, lambda g, m: F.when(m, F.transform(g, lambda a: F.lit(value).cast("tinyint"))).otherwise(g))


def _count_alleles_of(gt: Column, want: Callable[[Column], Column], fill: int, mask: Column | None) -> Column:
    def one(g: Column) -> Column:
        n = F.size(F.filter(g, want))
        return n if fill == 0 else F.when(_all_called(g), n).otherwise(fill)

    if mask is None:
        return F.transform(gt, one)
    return F.zip_with(gt, mask, lambda g, m: F.when(m, F.lit(fill)).otherwise(one(g)))


def to_n_ref(gt: Column, fill: int = 0, mask: Column | None = None) -> Column:
    """Reference alleles of each call; with fill 0 a half-missing call still counts what it has."""
    return _count_alleles_of(gt, lambda a: a == 0, fill, mask)


def to_n_alt(gt: Column, fill: int = 0, mask: Column | None = None) -> Column:
    return _count_alleles_of(gt, lambda a: a > 0, fill, mask)


def to_allele_counts(gt: Column, max_allele: int, mask: Column | None = None) -> Column:
    """Per call, how often it has each allele up to ``max_allele``."""

    def one(g: Column) -> Column:
        return F.array(*[_times(g, k).cast("smallint") for k in range(max_allele + 1)])

    if mask is None:
        return F.transform(gt, one)
    none = F.array(*[F.lit(0).cast("smallint")] * (max_allele + 1))
    return F.zip_with(gt, mask, lambda g, m: F.when(m, none).otherwise(one(g)))


def to_gt(gt: Column, phased: Column | None = None, mask: Column | None = None) -> Column:
    """VCF text of each call: ``.`` for missing alleles, ``|`` where phased."""

    def text(g: Column, sep: str) -> Column:
        return F.array_join(F.transform(g, lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))), sep)

    out = F.transform(gt, lambda g: text(g, "/")) if phased is None else F.zip_with(gt, phased, lambda g, p: F.when(p, text(g, "|")).otherwise(text(g, "/")))
    if mask is None:
        return out
    dots = F.transform(gt, lambda g: F.array_join(F.transform(g, lambda a: F.lit(".")), "/"))
    return F.transform(F.arrays_zip(out.alias("t"), dots.alias("d"), mask.alias("m")), lambda z: F.when(z["m"], z["d"]).otherwise(z["t"]))


def map_alleles(h: Column, mapping: Column) -> Column:
    """Haplotype alleles through ``mapping``; missing and unmapped ones become -1."""
    return F.transform(h, lambda a: F.when((a >= 0) & (a < F.size(mapping)), F.get(mapping, a.cast("int"))).otherwise(-1).cast("tinyint"))


def map_call_alleles(gt: Column, mapping: Column) -> Column:
    return F.transform(gt, lambda g: map_alleles(g, mapping))


def to_haplotypes(gt: Column) -> Column:
    return F.flatten(gt)


def to_genotypes(h: Column, ploidy: int = 2) -> Column:
    """Haplotypes in calls of ``ploidy``; their number must be divisible."""
    checked = F.when(F.size(h) % ploidy != 0, F.raise_error(F.lit("haplotypes are not divisible by ploidy")).cast("array<tinyint>")).otherwise(h)
    return F.transform(F.sequence(F.lit(0), (F.size(checked) / ploidy).cast("int") - 1), lambda i: F.slice(h, (i * ploidy + 1).cast("int"), F.lit(ploidy)))


def pack_diploid(gt: Column) -> Column:
    """One number from 0 to 255 a call; alleles are -1 to 14 and hom-ref is 0."""
    return F.transform(gt, lambda g: F.pmod((F.shiftleft((g[0] + 1).cast("int"), 4).bitwiseOR((g[1] + 1).cast("int").bitwiseAND(15))) - 17, F.lit(256)).cast("smallint"))


def unpack_diploid(packed: Column) -> Column:
    def one(p: Column) -> Column:
        q = F.pmod(p.cast("int") + 17, F.lit(256))
        return F.array((F.shiftright(q, 4) - 1).cast("tinyint"), (q.bitwiseAND(15) - 1).cast("tinyint"))

    return F.transform(packed, one)


def haploidify(gt: Column, seed: int = 0, key: Column | None = None) -> Column:
    """One allele of each call, chosen by a hash of the row's key and the sample, so reruns agree."""
    k = F.lit(0) if key is None else key
    return F.transform(gt, lambda g, i: g[F.pmod(F.xxhash64(k, i, F.lit(seed)), F.size(g)).cast("int")])


# haplotypes


def h_is_called(h: Column) -> Column:
    return F.transform(h, lambda a: a >= 0)


def h_is_missing(h: Column) -> Column:
    return F.transform(h, lambda a: a < 0)


def h_is_ref(h: Column) -> Column:
    return F.transform(h, lambda a: a == 0)


def h_is_alt(h: Column, allele: int | None = None) -> Column:
    return F.transform(h, (lambda a: a > 0) if allele is None else (lambda a: a == allele))


def h_is_call(h: Column, allele: int) -> Column:
    return F.transform(h, lambda a: a == allele)


def count_alleles(h: Column, max_allele: int, select: Sequence[int] | None = None) -> Column:
    """Allele counts over haplotypes [those selected, repeats counting twice]; others are ignored."""
    if select is not None:
        h = F.transform(F.array(*[F.lit(int(i)) for i in select]), lambda i: h[i])
    return F.array(*[_times(h, k).cast("bigint") for k in range(max_allele + 1)])


def sample_to_haplotype_selection(indices: Sequence[int], ploidy: int) -> list[int]:
    return [i * ploidy + j for i in indices for j in range(ploidy)]


# calls given as allele counts (``gac``: ARRAY<ARRAY<SMALLINT>>)


def _present(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: x > 0))


def gac_is_called(gac: Column) -> Column:
    """Any allele known: a half-missing call counts as called here."""
    return F.transform(gac, lambda c: F.exists(c, lambda x: x > 0))


def gac_is_missing(gac: Column) -> Column:
    return F.transform(gac, lambda c: F.forall(c, lambda x: x == 0))


def gac_is_hom(gac: Column, allele: int | None = None) -> Column:
    if allele is None:
        return F.transform(gac, lambda c: _present(c) == 1)
    return F.transform(gac, lambda c: (_present(c) == 1) & (c[allele] > 0))


def gac_is_hom_ref(gac: Column) -> Column:
    return gac_is_hom(gac, 0)


def gac_is_hom_alt(gac: Column) -> Column:
    return F.transform(gac, lambda c: (_present(c) == 1) & (c[0] == 0))


def gac_is_het(gac: Column, allele: int | None = None) -> Column:
    if allele is None:
        return F.transform(gac, lambda c: _present(c) > 1)
    return F.transform(gac, lambda c: (_present(c) > 1) & (c[allele] > 0))


def gac_allelism(gac: Column) -> Column:
    return F.transform(gac, _present)


def gac_max_allele(gac: Column) -> Column:
    return F.transform(gac, lambda c: F.coalesce(F.array_max(F.transform(c, lambda x, i: F.when(x > 0, i).otherwise(-1))), F.lit(-1)))


def gac_is_variant(gac: Column) -> Column:
    return F.transform(gac, lambda c: F.exists(F.slice(c, F.lit(2), F.size(c)), lambda x: x > 0))


def gac_is_non_variant(gac: Column) -> Column:
    return F.transform(gac, lambda c: ~F.exists(F.slice(c, F.lit(2), F.size(c)), lambda x: x > 0))


def gac_is_segregating(gac: Column) -> Column:
    return F.transform(gac, lambda c: _present(c) > 1)


def gac_is_non_segregating(gac: Column, allele: int | None = None) -> Column:
    """At most one allele; with ``allele``: that one and no other."""
    if allele is None:
        return F.transform(gac, lambda c: _present(c) <= 1)
    return gac_is_hom(gac, allele)


def gac_is_biallelic(gac: Column) -> Column:
    return F.transform(gac, lambda c: _present(c) == 2)


def gac_is_biallelic_01(gac: Column) -> Column:
    return F.transform(gac, lambda c: (_present(c) == 2) & (c[0] > 0) & (c[1] > 0))


def gac_to_frequencies(gac: Column) -> Column:
    def one(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0), lambda s, x: s + x.cast("int"))
        return F.transform(c, lambda x: F.try_divide(x.cast("double"), n.cast("double")))

    return F.transform(gac, one)


def gac_to_gt(gac: Column) -> Column:
    return F.transform(gac, lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ":"))


def gac_count_alleles(gac: Column, select: Sequence[int] | None = None) -> Column:
    """Sum over calls [those selected]."""
    if select is not None:
        gac = F.transform(F.array(*[F.lit(int(i)) for i in select]), lambda i: gac[i])
    zero = F.transform(gac[0], lambda x: F.lit(0).cast("bigint"))
    return F.aggregate(gac, zero, lambda s, c: F.zip_with(s, c, lambda a, b: a + b.cast("bigint")))
