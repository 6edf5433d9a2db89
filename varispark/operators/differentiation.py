"""Population differentiation and admixture: Fst, f3 and D per window, and with block-jackknife errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varispark.functions import calls, counts as C
from varispark.operators import windows as W
from varispark.session import materialise, ship_package


def jackknife_ratio(blocks: DataFrame, num: str, den: str, overall: tuple[Column, Column] | None = None) -> DataFrame:
    """Delete-one jackknife of sum(num) / sum(den) over block sums.

    One row: estimate, se, n_blocks, block values (vb) and replicates (vj) in block order.
    An undefined replicate leaves the error undefined.
    """
    everything = Window.partitionBy()
    rows = blocks.withColumn("vb", F.try_divide(num, den))
    rows = rows.withColumn("vj", F.try_divide(F.sum(num).over(everything) - F.coalesce(num, F.lit(0.0)), F.sum(den).over(everything) - F.coalesce(den, F.lit(0.0))))
    rows = rows.withColumn("m", F.avg("vj").over(everything))
    got = rows.agg(
        F.count("*").alias("n"),
        F.count("vj").alias("n_defined"),
        F.sum((F.col("vj") - F.col("m")) * (F.col("vj") - F.col("m"))).alias("ss"),
        F.try_divide(F.sum(num), F.sum(den)).alias("estimate"),
        F.transform(F.array_sort(F.collect_list(F.struct("w", "vb"))), lambda x: x["vb"]).alias("vb"),
        F.transform(F.array_sort(F.collect_list(F.struct("w", "vj"))), lambda x: x["vj"]).alias("vj"),
    )
    se = F.when(F.col("n") == F.col("n_defined"), F.sqrt((F.col("n") - 1) / F.col("n") * F.col("ss")))
    return got.select("estimate", se.alias("se"), F.col("n").alias("n_blocks"), "vb", "vj")


def jackknife(values: DataFrame, value: str) -> DataFrame:
    """Delete-one jackknife of the mean: mean of replicates, se and n, from sums alone."""
    x, n = F.col(value), F.count(value)
    return values.agg(F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(n)).alias("se"), n.alias("n"))


def jackknife_of(values: DataFrame, columns: Sequence[str], statistic: Callable[..., float], order: str, most: int = 1_000_000) -> DataFrame:
    """(k, vj, mean, se): the statistic of the columns with row k left out, k by ``order``.

    ``statistic`` gets one array a column. It needs all values at once, so they are sent to
    every task: more than ``most`` rows (blocks, as a rule) are refused. Replicates are
    computed on the executors.
    """
    n = values.count()
    if n > most:
        raise ValueError(f"{n} values, {most} at most")
    spark = values.sparkSession
    ship_package(spark)
    t = values.select(order, *columns).orderBy(order).toArrow()
    arrays = spark.sparkContext.broadcast([t.column(1 + c).to_numpy() for c in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("k").to_pylist()
            vj = [float(statistic(*(np.delete(x, k) for x in arrays.value))) for k in at]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(vj, pa.float64())], ["k", "vj"])

    got = materialise(spark.range(n).withColumnRenamed("id", "k").mapInArrow(run, "k bigint, vj double"))
    m = got.agg(F.avg("vj").alias("mean"), (F.sqrt((F.count("vj") - 1) / F.count("vj")) * F.sqrt(F.var_pop("vj") * F.count("vj"))).alias("se"))
    return got.crossJoin(F.broadcast(m))


def with_ratio_parts(df: DataFrame, parts: tuple[Column, Column]) -> DataFrame:
    """num and den of each variant; a NULL on one side doesn't remove the other's."""
    return df.withColumn("_num", parts[0]).withColumn("_den", parts[1])


def _sums() -> dict[str, Column]:
    return {"_num": F.sum("_num"), "_den": F.sum("_den")}


def windowed_ratio(df: DataFrame, parts: tuple[Column, Column], size: int, start=None, stop=None, step=None, out: str = "fst") -> DataFrame:
    got = W.windowed(with_ratio_parts(df, parts), {"_a": F.sum("_num"), "_b": F.sum("_den")}, size, start, stop, step)
    return got.withColumn(out, F.try_divide("_a", "_b")).drop("_a", "_b")


def moving_ratio(df: DataFrame, parts: tuple[Column, Column], size: int, start: int = 0, stop=None, step=None, out: str = "fst") -> DataFrame:
    got = W.moving(with_ratio_parts(df, parts), {"_a": F.sum("_num"), "_b": F.sum("_den")}, size, start, stop, step)
    return got.select("w", F.try_divide("_a", "_b").alias(out))


def average_ratio(df: DataFrame, parts: tuple[Column, Column], blen: int) -> DataFrame:
    """Overall ratio over all variants; error from full blocks of ``blen`` variants."""
    rows = with_ratio_parts(df, parts)
    blocks = W.moving(rows, _sums(), blen)
    everything = rows.agg(F.try_divide(F.sum("_num"), F.sum("_den")).alias("overall"))
    return jackknife_ratio(blocks, "_num", "_den").crossJoin(F.broadcast(everything)).withColumn("estimate", F.col("overall")).drop("overall")


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def windowed_hudson_fst(df: DataFrame, ac1: str, ac2: str, size: int, **kw) -> DataFrame:
    return windowed_ratio(df, C.hudson_fst(*_c(ac1, ac2)), size, **kw)


def moving_hudson_fst(df: DataFrame, ac1: str, ac2: str, size: int, **kw) -> DataFrame:
    return moving_ratio(df, C.hudson_fst(*_c(ac1, ac2)), size, **kw)


def average_hudson_fst(df: DataFrame, ac1: str, ac2: str, blen: int) -> DataFrame:
    return average_ratio(df, C.hudson_fst(*_c(ac1, ac2)), blen)


def windowed_patterson_fst(df: DataFrame, ac1: str, ac2: str, size: int, **kw) -> DataFrame:
    return windowed_ratio(df, C.patterson_fst(*_c(ac1, ac2)), size, **kw)


def moving_patterson_fst(df: DataFrame, ac1: str, ac2: str, size: int, **kw) -> DataFrame:
    return moving_ratio(df, C.patterson_fst(*_c(ac1, ac2)), size, **kw)


def average_patterson_fst(df: DataFrame, ac1: str, ac2: str, blen: int) -> DataFrame:
    return average_ratio(df, C.patterson_fst(*_c(ac1, ac2)), blen)


def moving_patterson_f3(df: DataFrame, acc: str, aca: str, acb: str, size: int, normed: bool = True, **kw) -> DataFrame:
    t, b = C.patterson_f3(*_c(acc, aca, acb))
    if normed:
        return moving_ratio(df, (t, b), size, out="f3", **kw)
    return W.moving(df.withColumn("_t", t), {"f3": F.avg("_t")}, size, **kw)


def average_patterson_f3(df: DataFrame, acc: str, aca: str, acb: str, blen: int, normed: bool = True) -> DataFrame:
    t, b = C.patterson_f3(*_c(acc, aca, acb))
    parts = (t, b) if normed else (t, F.when(t.isNotNull(), 1.0))
    return average_ratio(df, parts, blen).withColumn("z", F.try_divide("estimate", "se"))


def moving_patterson_d(df: DataFrame, aca: str, acb: str, acc: str, acd: str, size: int, **kw) -> DataFrame:
    return moving_ratio(df, C.patterson_d(*_c(aca, acb, acc, acd)), size, out="d", **kw)


def average_patterson_d(df: DataFrame, aca: str, acb: str, acc: str, acd: str, blen: int) -> DataFrame:
    return average_ratio(df, C.patterson_d(*_c(aca, acb, acc, acd)), blen).withColumn("z", F.try_divide("estimate", "se"))


def weir_cockerham(df: DataFrame, subpops: Sequence[Sequence[int]], max_allele: int, gt: str = "gt") -> DataFrame:
    """Variance components of each variant, summed over alleles: wc_a, wc_b, wc_c.

    Diploid calls. The sums leave out alleles whose component is undefined; wc_den sums
    a + b + c over the alleles where all three are defined.
    """
    r = float(len(subpops))
    h = calls.to_haplotypes(F.col(gt))
    d = df
    for j, pop in enumerate(subpops):
        d = d.withColumn(f"_ac{j}", calls.count_alleles(h, max_allele, calls.sample_to_haplotype_selection(pop, 2)))
    chosen = F.transform(F.array(*[F.lit(i) for pop in subpops for i in pop]), lambda i: F.col(gt)[i])
    d = d.withColumn("_sel", chosen)
    d = d.withColumn("_n", F.array(*[F.floor(C.total(F.col(f"_ac{j}")) / F.lit(2)).cast("double") for j in range(len(subpops))]))
    d = d.withColumn("_an", F.array(*[C.total(F.col(f"_ac{j}")).cast("double") for j in range(len(subpops))]))
    d = d.withColumn("_nt", F.aggregate("_n", F.lit(0.0), lambda s, x: s + x)).withColumn("_ant", F.aggregate("_an", F.lit(0.0), lambda s, x: s + x))
    d = d.withColumn("_nb", F.col("_nt") / r)
    squares = F.aggregate("_n", F.lit(0.0), lambda s, x: s + x * x)
    d = d.withColumn("_nc", (F.col("_nt") - F.try_divide(squares, F.col("_nt"))) / (r - 1))
    parts = []
    nb, nc, nt = F.col("_nb"), F.col("_nc"), F.col("_nt")
    for k in range(max_allele + 1):
        got = [F.col(f"_ac{j}")[k].cast("double") for j in range(len(subpops))]
        p_bar = F.try_divide(sum(got[1:], got[0]), F.col("_ant"))
        spread = [F.col("_n")[j] * F.pow(F.try_divide(got[j], F.col("_an")[j]) - p_bar, F.lit(2.0)) for j in range(len(subpops))]
        s2 = F.try_divide(sum(spread[1:], spread[0]), nb * (r - 1))
        h_bar = F.try_divide(calls.count_true(calls.is_het(F.col("_sel"), k)).cast("double"), nt)
        inner = p_bar * (1 - p_bar) - (r - 1) * s2 / r
        a = F.try_divide(nb, nc) * (s2 - F.try_divide(F.lit(1.0), nb - 1) * (inner - h_bar / 4))
        b = F.try_divide(nb, nb - 1) * (inner - F.try_divide((2 * nb - 1) * h_bar, 4 * nb))
        parts.append(F.struct(a.alias("a"), b.alias("b"), (h_bar / 2).alias("c")))
    d = d.withColumn("wc", F.array(*parts))
    add = lambda f: F.aggregate("wc", F.lit(0.0), lambda s, x: s + F.coalesce(f(x), F.lit(0.0)))
    d = d.withColumn("wc_a", add(lambda x: x["a"])).withColumn("wc_b", add(lambda x: x["b"])).withColumn("wc_c", add(lambda x: x["c"])).withColumn("wc_den", add(lambda x: x["a"] + x["b"] + x["c"]))
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def windowed_weir_cockerham_fst(df: DataFrame, subpops, size: int, max_allele: int, **kw) -> DataFrame:
    return windowed_ratio(weir_cockerham(df, subpops, max_allele), (F.col("wc_a"), F.col("wc_a") + F.col("wc_b") + F.col("wc_c")), size, **kw)


def moving_weir_cockerham_fst(df: DataFrame, subpops, size: int, max_allele: int, **kw) -> DataFrame:
    return moving_ratio(weir_cockerham(df, subpops, max_allele), (F.col("wc_a"), F.col("wc_den")), size, **kw)


def average_weir_cockerham_fst(df: DataFrame, subpops, blen: int, max_allele: int) -> DataFrame:
    return average_ratio(weir_cockerham(df, subpops, max_allele), (F.col("wc_a"), F.col("wc_a") + F.col("wc_b") + F.col("wc_c")), blen)


def pbs(df: DataFrame, ac1: str, ac2: str, ac3: str, size: int, normed: bool = True, **kw) -> DataFrame:
    """Population branch statistic of index windows, from three Hudson Fst clipped to [0, 0.99999]."""
    names = (("f12", ac1, ac2), ("f13", ac1, ac3), ("f23", ac2, ac3))
    rows = df
    for n, a, b in names:
        num, den = C.hudson_fst(*_c(a, b))
        rows = rows.withColumn(f"_n{n}", num).withColumn(f"_d{n}", den)
    sums = {f"_{s}{n}": F.sum(f"_{s}{n}") for n, _, _ in names for s in "nd"}
    got = W.moving(rows, sums, size, **kw)
    t = []
    for n, _, _ in names:
        fst = F.try_divide(F.col(f"_n{n}"), F.col(f"_d{n}"))
        t.append(-F.ln(1 - F.when(fst.isNotNull(), F.least(F.greatest(fst, F.lit(0.0)), F.lit(0.99999)))))
    raw = (t[0] + t[1] - t[2]) / 2
    if normed:
        raw = raw / (1 + (t[0] + t[1] + t[2]) / 2)
    return got.select("w", raw.alias("pbs"))
