"""Transmission of alleles in families: Mendelian errors, painting and phasing."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.operators.ordered import ordered, pieces

#: Codes of inheritance states.
UNDETERMINED, PARENT1, PARENT2, NONSEG_REF, NONSEG_ALT, NONPARENTAL, PARENT_MISSING, MISSING = range(8)


def mendel_errors(gt: Column) -> Column:
    """Errors (0 to 2) of each progeny; calls 0 and 1 are the parents, diploid.

    Alleles that no parent can give count one each; both alleles from one parent, where
    the parents share none, count one; a missing parent gives 0.
    """
    p1, p2 = gt[0], gt[1]
    has = lambda p, a: F.exists(p, lambda x: x == a)
    times = lambda g, a: F.size(F.filter(g, lambda x: x == a))
    share = F.exists(p1, lambda a: (a >= 0) & has(p2, a))
    gone = F.exists(F.concat(p1, p2), lambda a: a < 0)

    def one(g: Column) -> Column:
        known = F.array_distinct(F.filter(g, lambda a: a >= 0))
        excess = F.aggregate(known, F.lit(0), lambda s, a: s + F.greatest(F.lit(0), times(g, a) - has(p1, a).cast("int") - has(p2, a).cast("int")))
        same = F.array_sort(g).eqNullSafe(F.array_sort(p1)) | F.array_sort(g).eqNullSafe(F.array_sort(p2))
        return F.when(gone, 0).when(~share & same, 1).otherwise(excess)

    return F.transform(F.slice(gt, F.lit(3), F.size(gt)), one)


def paint_transmission(parent: Column, progeny: Column) -> Column:
    """Inheritance code of each progeny gamete from a parent's two haplotypes."""
    a, b = parent[0], parent[1]
    hom = a == b

    def one(x: Column) -> Column:
        return (
            F.when(x < 0, MISSING)
            .when((a < 0) | (b < 0), PARENT_MISSING)
            .when((x != a) & (x != b), NONPARENTAL)
            .when(hom & (a > 0), NONSEG_ALT)
            .when(hom, NONSEG_REF)
            .when(x == b, PARENT2)
            .otherwise(PARENT1)
        )

    return F.transform(progeny, one)


def phase_progeny(gt: Column) -> Column:
    """Per sample struct(g, phased): progeny alleles with the maternal one first where it can be told."""
    m, p = gt[0], gt[1]
    known = F.forall(F.concat(m, p), lambda a: a >= 0)
    has = lambda q, a: F.exists(q, lambda x: x == a)
    keep = lambda g, phased: F.struct(g.alias("g"), phased.alias("phased"))

    def one(g: Column, i: Column) -> Column:
        x, y = g[0], g[1]
        fine = known & (x >= 0) & (y >= 0) & (i > 1)
        hom = fine & (x == y) & has(m, x) & has(p, x)
        straight = fine & (x != y) & ((has(m, x) & ~has(p, x) & has(p, y)) | (has(p, y) & ~has(m, y) & has(m, x)))
        swapped = fine & (x != y) & ((has(m, y) & ~has(p, y) & has(p, x)) | (has(p, x) & ~has(m, x) & has(m, y)))
        return F.when(hom | straight, keep(g, F.lit(True))).when(swapped, keep(F.array(y, x), F.lit(True))).otherwise(keep(g, F.lit(False)))

    return F.transform(gt, one)


def phase_progeny_by_transmission(df: DataFrame, gt: str = "gt") -> DataFrame:
    """``gt`` with phased progeny, and ``is_phased``."""
    out = df.withColumn("_p", phase_progeny(F.col(gt)))
    return out.withColumn(gt, F.transform("_p", lambda z: z["g"])).withColumn("is_phased", F.transform("_p", lambda z: z["phased"])).drop("_p")


def phase_parents_by_transmission(df: DataFrame, window_size: int, gt: str = "gt", by: str | None = None) -> DataFrame:
    """Phase parents by linkage with up to ``window_size`` earlier informative variants.

    Sequential along vidx in each group of ``by`` (a chromosome), one task a group, which
    holds a batch of rows and, of each informative variant in reach, two sets of progeny:
    those that got the parent's first allele, and its second one.
    """

    def sets(on: np.ndarray) -> list[int]:
        return [int.from_bytes(bits.tobytes(), "little") for bits in np.packbits(on, axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, seen = [deque(maxlen=window_size) for _ in range(2)], [False, False]
        for fresh, batch in pieces(batches):
            if fresh:
                reach, seen = [deque(maxlen=window_size) for _ in range(2)], [False, False]
            n, calls = batch.num_rows, batch.column("gt")
            g = np.array(_even(_even(calls), 2).to_numpy(zero_copy_only=False), np.int8).reshape(n, -1, 2)
            phased = np.array(_even(batch.column("is_phased")).to_numpy(zero_copy_only=False), bool).reshape(n, -1)
            told = phased[:, 2:].any(1)
            for parent in range(2):
                first, second = g[:, parent, 0].copy(), g[:, parent, 1].copy()
                het = told & (first != second)
                known = told & ~phased[:, parent] & (first >= 0) & (second >= 0)
                given = het & phased[:, parent]
                phased[known & ~het, parent] = True
                rows = np.flatnonzero(given | (known & het))
                got = g[rows, 2:, parent]
                one, two = (sets(phased[rows, 2:] & (got == a[rows, None])) for a in (first, second))
                before = reach[parent]
                for i, a, b in zip(rows.tolist(), one, two, strict=True):
                    if not given[i]:
                        votes = 0
                        for c, d in before:
                            more = (a & c).bit_count() + (b & d).bit_count() - (b & c).bit_count() - (a & d).bit_count()
                            votes += (more > 0) - (more < 0)
                        if not votes and seen[parent]:
                            continue
                        if votes < 0:
                            g[i, parent] = second[i], first[i]
                            a, b = b, a
                        phased[i, parent] = True
                    before.append((a, b))
                    seen[parent] = True
            samples = g.shape[1]
            pairs = pa.ListArray.from_arrays(np.arange(0, 2 * n * samples + 1, 2, dtype=np.int32), pa.array(g.ravel()))
            ends = pa.array(np.arange(0, n * samples + 1, samples, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vidx"), pa.ListArray.from_arrays(ends, pairs), pa.ListArray.from_arrays(ends, pa.array(phased.ravel()))], ["vidx", "gt", "is_phased"])

    columns = F.col(gt).cast("array<array<tinyint>>").alias("gt"), F.col("is_phased").alias("is_phased")
    return ordered(df, by, *columns).mapInArrow(run, "vidx bigint, gt array<array<tinyint>>, is_phased array<boolean>")


def _even(column: pa.Array, length: int | None = None) -> pa.Array:
    """Elements of lists of one length."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (len(size) and (size != (length or size[0])).any()):
        raise ValueError("rows with calls of unequal number")
    return column.flatten()


def phase_by_transmission(df: DataFrame, window_size: int, gt: str = "gt", by: str | None = None) -> DataFrame:
    # progeny are phased row by row, in as many tasks as there is room for, however few files were read
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, "vidx")
    return phase_parents_by_transmission(phase_progeny_by_transmission(spread, gt), window_size, gt, by)
