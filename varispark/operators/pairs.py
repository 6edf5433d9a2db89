"""Operators on pairs: linkage between variants, distances between samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_FLOOR, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.operators import windows as W
from varispark.operators.diversity import mask_inaccessible
from varispark.operators.ordered import ordered, pieces
from varispark.session import materialise, ship_package


def r_value(x: Column, y: Column) -> Column:
    """Rogers-Huff r over the calls present in both rows (negative counts are missing); NULL for constant rows."""
    both = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: (z["x"] >= 0) & (z["y"] >= 0))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "sx", "sy", "xx", "yy", "xy")])

    def step(s: Column, z: Column) -> Column:
        a, b = z["x"].cast("double"), z["y"].cast("double")
        return F.struct((s["n"] + 1).alias("n"), (s["sx"] + a).alias("sx"), (s["sy"] + b).alias("sy"), (s["xx"] + a * a).alias("xx"), (s["yy"] + b * b).alias("yy"), (s["xy"] + a * b).alias("xy"))

    def end(s: Column) -> Column:
        cov = s["n"] * s["xy"] - s["sx"] * s["sy"]
        return F.try_divide(cov, F.sqrt((s["n"] * s["xx"] - s["sx"] * s["sx"]) * (s["n"] * s["yy"] - s["sy"] * s["sy"])))

    return F.aggregate(both, zero, step, end)


def rogers_huff_r(df: DataFrame, gn: str = "gn", within: int | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, r) for pairs of variants i < j [at most ``within`` rows apart, joined by blocks; r rounded half up to ``digits``]."""
    if within is None:
        return _all_r(df, gn, digits)
    a = df.select(F.col("vidx").alias("i"), F.col(gn).alias("x"))
    b = df.select(F.col("vidx").alias("j"), F.col(gn).alias("y"))
    a = a.withColumn("_b", F.floor(F.col("i") / within))
    b = b.withColumn("_b", F.explode(F.array(F.floor(F.col("j") / within), F.floor(F.col("j") / within) - 1)))
    pairs = a.join(b, "_b").where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= within))
    r = r_value(F.col("x"), F.col("y"))
    return pairs.select("i", "j", (r if digits is None else F.round(r, digits)).alias("r"))


#: Variants of a block; a task holds the sums of one pair of blocks at a time.
_BLOCK = 500
#: Rows of a block whose sums are made at once, so that they stay in the processor's cache.
_STRIP = 64


def _call_matrix(column: pa.Array) -> np.ndarray:
    """Calls by row, missing ones -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column) and not column.null_count and (size == size[0]).all():
        m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        return np.where(np.isnan(m), -1.0, m)
    rows = column.to_pylist()
    m = np.full((len(rows), max([len(c) for c in rows if c is not None], default=0)), -1.0)
    for at, c in enumerate(rows):
        if c is not None:
            m[at, : len(c)] = [-1.0 if a is None else a for a in c]
    return m


def _rounded(r: np.ndarray, digits: int) -> np.ndarray:
    """Half up by the decimal digits of the number, as ``F.round`` does, without a decimal for each."""
    scale = 10.0**digits
    t = np.abs(r) * scale + 0.5
    out = np.floor(t)
    for at in np.flatnonzero(np.abs(t - np.rint(t)) < 1e-5):
        out[at] = int((abs(Decimal(repr(float(r[at])))).scaleb(digits) + Decimal("0.5")).to_integral_value(ROUND_FLOOR))
    return np.copysign(out / scale, r) + 0.0


def _all_r(df: DataFrame, gn: str, digits: int | None) -> DataFrame:
    """r of all pairs i < j: a row for each pair of blocks, whose sums are matrix products."""
    ship_package(df.sparkSession)
    rows = df.select(F.col("vidx").cast("bigint").alias("vidx"), F.col(gn).cast("array<double>").alias("gn"), F.floor(F.col("vidx") / _BLOCK).alias("b"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vidx")
        m = _call_matrix(table.column("gn"))
        m[~(m >= 0)] = -1.0
        small = m.astype(np.int8) if m.max(initial=0) < 128 else m
        calls = small if (small == m).all() else m
        return pa.table({"b": table.column("b").slice(0, 1), "vidx": pa.array([table.column("vidx").to_numpy().tobytes()], pa.binary()), "calls": pa.array([calls.tobytes()], pa.binary()), "small": [calls.dtype == np.int8]})

    blocks = rows.groupBy("b").applyInArrow(pack, "b bigint, vidx binary, calls binary, small boolean")
    pairs = blocks.alias("x").join(blocks.alias("y"), F.col("x.b") <= F.col("y.b"))
    pairs = pairs.select(*[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "xy" for c in ("vidx", "calls", "small")])
    n = df.sparkSession.sparkContext.defaultParallelism * 8

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                i, j = (np.frombuffer(of[f"{k}_vidx"], np.int64) for k in "xy")
                calls = [np.frombuffer(of[f"{k}_calls"], np.int8 if of[f"{k}_small"] else float).reshape(len(v), -1).astype(float) for k, v in (("x", i), ("y", j))]
                width = max(m.shape[1] for m in calls)
                (x, p), (y, q) = ((np.where(m >= 0, m, 0.0), (m >= 0).astype(float)) for m in (np.pad(m, ((0, 0), (0, width - m.shape[1])), constant_values=-1.0) for m in calls))
                xx, yt, qt, yyt = x * x, y.T.copy(), q.T.copy(), (y * y).T.copy()
                first = np.searchsorted(j, i, "right")  # of each i, its first later j
                for at in range(0, len(i), _STRIP):
                    s = slice(at, at + _STRIP)
                    c = p[s] @ qt
                    sx, sy = x[s] @ qt, p[s] @ yt
                    cov = c * (x[s] @ yt) - sx * sy
                    spread = (c * (xx[s] @ qt) - sx * sx) * (c * (p[s] @ yyt) - sy * sy)
                    yes = spread > 0
                    r = np.divide(cov, np.sqrt(spread, where=yes, out=spread), where=yes, out=np.zeros_like(cov)).ravel()
                    later = np.broadcast_to(j, cov.shape).ravel()
                    yes, size = yes.ravel(), len(j) - first[s]
                    if first[s].any():
                        on = (np.arange(len(j)) >= first[s][:, None]).ravel()
                        r, later, yes = r[on], later[on], yes[on]
                    if digits is not None:
                        r = _rounded(r, digits)
                    ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(i[s]), pa.ListArray.from_arrays(ends, pa.array(later)), pa.ListArray.from_arrays(ends, pa.array(r, mask=~yes))], ["i", "js", "rs"])

    # a row for each i and block, so that little is done for a single pair on the way
    found = pairs.repartition(n).mapInArrow(kernel, "i bigint, js array<bigint>, rs array<double>")
    return found.select("i", "js", F.posexplode("rs").alias("_k", "r")).select("i", F.get("js", F.col("_k")).alias("j"), "r")


def rogers_huff_r_between(a: DataFrame, b: DataFrame, gn: str = "gn") -> DataFrame:
    """(i, j, r) of every row of ``a`` with every row of ``b``: the full matrix is the result."""
    x = a.select(F.col("vidx").alias("i"), F.col(gn).alias("x"))
    return x.crossJoin(b.select(F.col("vidx").alias("j"), F.col(gn).alias("y"))).select("i", "j", r_value(F.col("x"), F.col("y")).alias("r"))


def windowed_r_squared(df: DataFrame, size: int, gn: str = "gn", start=None, stop=None, step=None, percentile: Sequence[float] = (50,)) -> DataFrame:
    """Percentiles of r squared of the pairs in each position window; pairs are made inside windows only."""
    low, high = W.position_bounds(df) if start is None or stop is None else (start, stop)
    start, stop = low if start is None else start, high if stop is None else stop
    rows = W.assign_position_windows(df, size, start, stop, step)
    a = rows.select("w", F.col("vidx").alias("i"), F.col(gn).alias("x"))
    b = rows.select("w", F.col("vidx").alias("j"), F.col(gn).alias("y"))
    r = a.join(b, "w").where("i < j").select("w", F.pow(r_value(F.col("x"), F.col("y")), F.lit(2.0)).alias("r2"))
    got = r.groupBy("w").agg(*[F.percentile("r2", F.lit(p / 100)).alias(f"p{p:g}") for p in percentile])
    n = rows.groupBy("w").agg(F.count("*").alias("n"))
    return W.position_windows_df(df.sparkSession, size, start, stop, step).join(n, "w", "left").join(got, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def locate_unlinked(df: DataFrame, size: int = 100, step: int = 20, threshold: float = 0.1, gn: str = "gn", by: str | None = None) -> DataFrame:
    """Greedy LD pruning in overlapping windows: (vidx, keep), sequential in each group of ``by``.

    The rows of a group (a chromosome) pass through one task in order; it holds a batch
    of them and the last ``size``. A row is compared once, with the kept rows before it in
    the first window that holds it.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, kept, n = np.zeros((0, 0)), np.zeros(0, bool), 0
        for fresh, batch in pieces(batches):
            if fresh:
                tail, kept, n = np.zeros((0, 0)), np.zeros(0, bool), 0
            x = _call_matrix(batch.column("gn"))
            width = max(x.shape[1], tail.shape[1])
            tail, x = (np.pad(m, ((0, 0), (0, width - m.shape[1])), constant_values=-1.0) for m in (tail, x))
            out = []
            for at in range(0, len(x), _STRIP):
                new = x[at : at + _STRIP]
                j = n + np.arange(len(new))
                if step > size:
                    low = np.where(j % step < size, j - j % step, j)
                else:
                    low = np.where(j < size, 0, ((j - size) // step + 1) * step)
                before = len(tail)
                tail = np.concatenate([tail, new])
                i = n - before + np.arange(len(tail))
                linked = _linked(new, tail, (i >= low[:, None]) & (i < j[:, None]), threshold)
                on = int.from_bytes(np.packbits(kept, bitorder="little").tobytes(), "little")
                keep = []
                for k, bits in enumerate(np.packbits(linked, axis=1, bitorder="little")):
                    keep.append(not int.from_bytes(bits.tobytes(), "little") & on)
                    on |= keep[-1] << (before + k)
                out += keep
                kept = np.concatenate([kept, np.array(keep, bool)])
                n += len(new)
                tail, kept = tail[max(0, len(tail) - size + 1) :], kept[max(0, len(kept) - size + 1) :]
            yield pa.RecordBatch.from_arrays([batch.column("vidx"), pa.array(out, pa.bool_())], ["vidx", "keep"])

    return ordered(df, by, F.col(gn).cast("array<double>").alias("gn")).mapInArrow(prune, "vidx bigint, keep boolean")


def _linked(y: np.ndarray, x: np.ndarray, asked: np.ndarray, threshold: float) -> np.ndarray:
    """[j, i], where asked: whether r squared of rows j of ``y`` and i of ``x`` is above the threshold, as ``_r`` tells."""
    (a, p), (b, q) = ((np.where(m >= 0, m, 0.0), (m >= 0).astype(float)) for m in (y, x))
    c = p @ q.T
    sa, sb, aa, bb = a @ q.T, p @ b.T, (a * a) @ q.T, p @ (b * b).T
    va, vb = c * aa - sa * sa, c * bb - sb * sb
    cov, spread = c * (a @ b.T) - sa * sb, va * vb
    defined = (va > 0) & (vb > 0)
    r2 = np.divide(cov * cov, spread, where=defined, out=np.zeros_like(cov))
    out = asked & (r2 > threshold)
    # sums of whole numbers are exact; where rounding could decide, the pair is computed by itself
    doubt = np.abs(r2 - threshold) < 1e-9
    if (a != np.rint(a)).any() or (b != np.rint(b)).any():
        doubt |= (va <= 1e-6 * c * aa) | (vb <= 1e-6 * c * bb) | (np.abs(r2 - threshold) < 1e-6)
    for j, i in zip(*np.nonzero(asked & doubt), strict=True):
        r = _r(x[i], y[j])
        out[j, i] = r == r and r * r > threshold
    return out


def _r(x: np.ndarray, y: np.ndarray) -> float:
    on = (x >= 0) & (y >= 0)
    x, y = x[on], y[on]
    if not len(x):
        return float("nan")
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / d) if d > 0 else float("nan")


def _abs_sum(f: Callable[[np.ndarray, np.ndarray], np.ndarray], combine=np.sum) -> Callable[[np.ndarray], np.ndarray]:
    """[i, j] over all columns: ``f`` of columns i and j, combined along the rows."""
    return lambda m: np.stack([combine(f(m[:, i : i + 1], m), 0) for i in range(m.shape[1])])


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros(np.broadcast(x, y).shape), where=y != 0)


def _cosine(xy, xx, yy):
    d = np.sqrt(xx * yy)
    return np.where(d > 0, 1 - _ratio(xy, d), np.nan)


#: Matrices over samples that add up (the maximum: join) over rows.
_TERMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "n": lambda m: np.full((m.shape[1],) * 2, float(len(m))),
    "xy": lambda m: m.T @ m,
    "xx": lambda m: np.repeat((m * m).sum(0)[:, None], m.shape[1], 1),
    "yy": lambda m: np.repeat((m * m).sum(0)[None, :], m.shape[1], 0),
    "x": lambda m: np.repeat(m.sum(0)[:, None], m.shape[1], 1),
    "y": lambda m: np.repeat(m.sum(0)[None, :], m.shape[1], 0),
    "abs": _abs_sum(lambda x, y: np.abs(x - y)),
    "max": _abs_sum(lambda x, y: np.abs(x - y), np.max),
    "differ": _abs_sum(lambda x, y: (x != y).astype(float)),
    "canberra": _abs_sum(lambda x, y: _ratio(np.abs(x - y), np.abs(x) + np.abs(y))),
    "plus": _abs_sum(lambda x, y: np.abs(x + y)),
}
#: The terms that a metric needs, and how it is made of their totals.
_METRICS: dict[str, tuple[tuple[str, ...], Callable[..., np.ndarray]]] = {
    "euclidean": (("xy", "xx", "yy"), lambda xy, xx, yy: np.sqrt(np.maximum(0, xx + yy - 2 * xy))),
    "sqeuclidean": (("xy", "xx", "yy"), lambda xy, xx, yy: np.maximum(0, xx + yy - 2 * xy)),
    "cityblock": (("abs",), lambda d: d),
    "chebyshev": (("max",), lambda d: d),
    "hamming": (("differ", "n"), lambda d, n: d / n),
    "canberra": (("canberra",), lambda d: d),
    "braycurtis": (("abs", "plus"), _ratio),
    "cosine": (("xy", "xx", "yy"), _cosine),
    "correlation": (("n", "xy", "xx", "yy", "x", "y"), lambda n, xy, xx, yy, x, y: _cosine(xy - x * y / n, xx - x * x / n, yy - y * y / n)),
}


def _by_matrices(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], terms: dict[str, Callable[[np.ndarray], np.ndarray]], finish: Callable[..., np.ndarray]) -> DataFrame:
    """(i, j, value), i < j: each task adds up its matrices over samples, whose rows are then added up by i."""
    ship_package(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                m = read(b)
                for k, f in terms.items():
                    x = f(m)
                    total[k] = x if k not in total else np.maximum(total[k], x) if k == "max" else total[k] + x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["term", "i", "values"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        i, total = key[0].as_py(), {}
        for k, raw in zip(t.column("term").to_pylist(), t.column("values").to_pylist(), strict=True):
            x = np.frombuffer(raw)
            total[k] = x if k not in total else np.maximum(total[k], x) if k == "max" else total[k] + x
        value = finish(*(total[k][i + 1 :] for k in terms))
        j = np.arange(i + 1, i + 1 + len(value), dtype=np.int32)
        return pa.table({"i": pa.array(np.full(len(j), i, np.int32)), "j": pa.array(j), "value": pa.array(value, pa.float64(), from_pandas=True)})

    return rows.mapInArrow(partial, "term string, i int, values binary").groupBy("i").applyInArrow(add, "i int, j int, value double")


def _read_matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1).astype(float)


def pairwise_distance(df: DataFrame, column: str = "gn", metric: str | Callable[[np.ndarray, np.ndarray], float] = "euclidean") -> DataFrame:
    """(i, j, distance) between columns of the array.

    Named metrics add up matrices over samples in each task; samples squared numbers a
    task are shuffled. A callable gets the two whole columns, in the order of ``vidx``: a
    task holds two of them at a time.
    """
    if callable(metric):
        return _pairs_by(df, column, metric)
    if metric not in _METRICS:
        raise ValueError(f"unrecognised metric {metric!r}")
    names, finish = _METRICS[metric]
    got = _by_matrices(df.select(F.col(column).cast("array<double>").alias("x")), _read_matrix, {k: _TERMS[k] for k in names}, finish)
    return got.withColumnRenamed("value", "distance")


def _pairs_by(df: DataFrame, column: str, f: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    long = df.select("vidx", F.posexplode(F.col(column).cast("array<double>")).alias("k", "v"))
    of = long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("vidx", "v"))), lambda x: x["v"]).alias("c"))
    of = materialise(of)
    n = of.count()
    # one row for each pair of columns: that is the result's size
    left = of.select(F.col("k").alias("i"), F.col("c").alias("x"), F.explode(F.sequence(F.col("k") + 1, F.greatest(F.lit(n - 1), F.col("k") + 1))).alias("j")).where(F.col("j") < n)
    pairs = left.join(of.select(F.col("k").alias("j"), F.col("c").alias("y")), "j").select("i", "j", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [float(f(np.asarray(x.values), np.asarray(y.values))) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("j"), pa.array(d, pa.float64())], ["i", "j", "distance"])

    return pairs.mapInArrow(run, "i int, j int, distance double")


#: Distances between columns by any metric, named or callable.
pdist = pairwise_distance


def pairwise_dxy(df: DataFrame, gac: str = "gac", start: int | None = None, stop: int | None = None, accessible: DataFrame | None = None) -> DataFrame:
    """(i, j, dxy) between samples, from per-call allele counts; per accessible base if intervals are given.

    The chance that two calls differ is 1 less the sum over alleles of the products of
    their shares, so the sums over variants are matrix products.
    """
    rows = df if start is None else df.where(F.col("pos") >= start)
    rows = rows if stop is None else rows.where(F.col("pos") <= stop)
    low, high = W.position_bounds(rows) if start is None or stop is None else (start, stop)
    start, stop = low if start is None else start, high if stop is None else stop
    if accessible is None:
        n = stop - start + 1
    else:
        rows = mask_inaccessible(rows, accessible)
        n = accessible.agg(F.sum(F.greatest(F.lit(0), F.least("stop", F.lit(stop)) - F.greatest("start", F.lit(start)) + 1))).first()[0]
    bases = float(n or 0)

    def read(b: pa.RecordBatch) -> np.ndarray:
        calls = b.column(0).flatten()
        return np.asarray(calls.flatten()).reshape(b.num_rows, len(calls) // b.num_rows, -1).astype(float)

    def apart(x: np.ndarray) -> np.ndarray:
        total = x.sum(2)
        share = _ratio(x, total[:, :, None])
        on = (total > 0).astype(float)
        return on.T @ on - sum(share[:, :, a].T @ share[:, :, a] for a in range(x.shape[2]))

    got = _by_matrices(rows.select(F.col(gac).cast("array<array<double>>").alias("x")), read, {"t": apart}, lambda t: t / bases if bases else np.full(len(t), np.nan))
    return got.withColumnRenamed("value", "dxy")


def condensed_coords(i: int, j: int, n: int) -> int:
    """Index of the pair in a condensed distance matrix of n observations."""
    if i == j or not (0 <= i < n and 0 <= j < n):
        raise ValueError("invalid pair")
    i, j = min(i, j), max(i, j)
    return i * (2 * n - i - 1) // 2 + j - i - 1


def condensed_coords_within(pop: Sequence[int], n: int) -> list[int]:
    return [condensed_coords(a, b, n) for k, a in enumerate(pop) for b in pop[k + 1 :]]


def condensed_coords_between(pop1: Sequence[int], pop2: Sequence[int], n: int) -> list[int]:
    return [condensed_coords(a, b, n) for a in pop1 for b in pop2]


def to_square(condensed: DataFrame, n: int) -> DataFrame:
    """(i, j, distance) for all i and j."""
    back = condensed.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")
    zero = condensed.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(0.0).alias("distance"))
    return condensed.unionByName(back).unionByName(zero)


def pcoa(condensed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal coordinates of n samples (their matrix, n * n numbers, is solved on the driver): coordinates and ratios."""
    d = np.zeros((n, n))
    for r in condensed.toLocalIterator():
        d[r["i"], r["j"]] = d[r["j"], r["i"]] = r["distance"]
    e = d * d / -2
    f = e - e.mean(0) - e.mean(1)[:, None] + e.mean()
    values, vectors = np.linalg.eigh(f)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    values[np.isclose(values, 0)] = 0
    on = values >= 0
    return vectors[:, on] * np.sqrt(values[on]), values[on] / values[on].sum()


def scale(gn: Column, scaler: str | None = "patterson", ploidy: int = 2) -> Column:
    """Centred [and standardised] alternate counts of a variant, in double; NULL for rows without spread."""
    n = F.size(gn)
    mean = F.aggregate(gn, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    if scaler in (None, "center", "centre"):
        return F.transform(gn, lambda x: x.cast("double") - mean)
    if scaler == "standard":
        sd = F.sqrt(F.aggregate(gn, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - mean, F.lit(2.0))) / n)
    elif scaler == "patterson":
        p = mean / ploidy
        sd = F.sqrt(p * (1 - p))
    else:
        raise ValueError(f"unrecognised scaler {scaler!r}")
    return F.when(sd > 0, F.transform(gn, lambda x: (x.cast("double") - mean) / sd))


class GenotypePCA:
    """PCA of samples. The Gram matrix over samples is summed on the executors; only samples squared numbers reach the driver."""

    def __init__(self, n_components: int = 10, scaler: str | None = "patterson", ploidy: int = 2, random_state: int | None = None, iterated_power: int | None = None):
        self.k, self.scaler, self.ploidy = n_components, scaler, ploidy
        self.random_state, self.iterated_power = random_state, iterated_power

    def fit(self, df: DataFrame, gn: str = "gn") -> GenotypePCA:
        x = df.select(scale(F.col(gn), self.scaler, self.ploidy).alias("x")).where("x is not null")

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                if len(b):
                    m = np.stack(b["x"].to_numpy())
                    total = m.T @ m if total is None else total + m.T @ m
            if total is not None:
                n = len(total)
                yield pd.DataFrame({"i": np.arange(n), "row": list(total)})

        rows = x.mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        rows = rows.toArrow()
        i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "v"))
        n = int(i.max()) + 1 if len(i) else 0
        g = np.zeros((n, n))
        g[i, j] = v
        values, vectors = self._solve(g)
        order = np.argsort(values)[::-1][: self.k]
        self.singular_values_ = np.sqrt(np.maximum(values[order], 0))
        self.coords_ = vectors[:, order] * self.singular_values_
        self.explained_variance_ = self.singular_values_**2 / n
        self.explained_variance_ratio_ = self.singular_values_**2 / np.trace(g)
        self.samples_ = vectors[:, order]
        return self

    def _solve(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.linalg.eigh(g)

    def fit_transform(self, df: DataFrame, gn: str = "gn") -> np.ndarray:
        return self.fit(df, gn).coords_

    def components(self, df: DataFrame, gn: str = "gn") -> DataFrame:
        """Loadings of each variant (vidx, loading), row-local given the sample vectors."""
        u, s = self.samples_, self.singular_values_
        x = df.select("vidx", scale(F.col(gn), self.scaler, self.ploidy).alias("x")).where("x is not null")
        weights = [F.array(*[F.lit(float(a)) for a in u[:, c] / s[c]]) for c in range(len(s))]
        dot = lambda w: F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda t, y: t + y)
        return x.select("vidx", F.array(*[dot(w) for w in weights]).alias("loading"))

    def transform(self, df: DataFrame, fitted_on: DataFrame, gn: str = "gn") -> DataFrame:
        """Project samples: (sidx, pc) with pc an array of components."""
        rows = df.select("vidx", scale(F.col(gn), self.scaler, self.ploidy).alias("x")).where("x is not null").join(self.components(fitted_on, gn), "vidx")
        long = rows.select(F.posexplode("x").alias("sidx", "v"), "loading").select("sidx", "v", F.posexplode("loading").alias("k", "w"))
        s = long.groupBy("sidx", "k").agg(F.sum(F.col("v") * F.col("w")).alias("pc"))
        return s.groupBy("sidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pc"))), lambda z: z["pc"]).alias("pc"))


def pca(df: DataFrame, n_components: int = 10, scaler: str | None = "patterson", ploidy: int = 2, gn: str = "gn") -> tuple[np.ndarray, GenotypePCA]:
    m = GenotypePCA(n_components, scaler, ploidy)
    return m.fit_transform(df, gn), m


class GenotypeRandomizedPCA(GenotypePCA):
    """PCA by a randomised range finder on the Gram matrix, whose passes over variants are the same one."""

    def _solve(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(g)
        r = np.random.default_rng(self.random_state)
        q = r.normal(size=(n, min(n, self.k + 10)))
        for _ in range(1 + (3 if self.iterated_power is None else self.iterated_power)):
            q, _ = np.linalg.qr(g @ q)
        values, vectors = np.linalg.eigh(q.T @ g @ q)
        return values, q @ vectors


def randomized_pca(df: DataFrame, n_components: int = 10, iterated_power: int = 3, random_state: int | None = None, scaler: str | None = "patterson", ploidy: int = 2, gn: str = "gn") -> tuple[np.ndarray, GenotypePCA]:
    m = GenotypeRandomizedPCA(n_components, scaler, ploidy, random_state, iterated_power)
    return m.fit_transform(df, gn), m


class Scaler:
    """Fits a location and a scale to each variant, and applies them to the same variants of other samples."""

    def __init__(self, kind: str | None = "patterson", ploidy: int = 2):
        if kind not in (None, "center", "centre", "standard", "patterson"):
            raise ValueError(f"unrecognised scaler {kind!r}")
        self.kind, self.ploidy = kind, ploidy

    def fit(self, df: DataFrame, gn: str = "gn") -> Scaler:
        n = F.size(gn)
        mean = F.aggregate(gn, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
        if self.kind == "standard":
            sd = F.sqrt(F.aggregate(gn, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - F.col("mean"), F.lit(2.0))) / n)
        elif self.kind == "patterson":
            sd = F.sqrt(F.col("mean") / self.ploidy * (1 - F.col("mean") / self.ploidy))
        else:
            sd = F.lit(1.0)
        rows = df.withColumn("mean", mean).withColumn("sd", sd)
        self.table_ = materialise(rows.select("vidx", "mean", "sd"))
        return self

    def transform(self, df: DataFrame, gn: str = "gn") -> DataFrame:
        """``df`` with its array scaled; NULL for variants without spread."""
        own = self.table_.select("vidx", F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
        scaled = F.when(F.col("_sd") > 0, F.transform(gn, lambda x: (x.cast("double") - F.col("_mean")) / F.col("_sd")))
        return df.join(own, "vidx").withColumn(gn, scaled).drop("_mean", "_sd")

    def fit_transform(self, df: DataFrame, gn: str = "gn") -> DataFrame:
        return self.fit(df, gn).transform(df, gn)


def get_scaler(scaler: str | None, ploidy: int = 2) -> Scaler:
    return Scaler(scaler, ploidy)
