"""Haplotype statistics: identity groups, EHH, and selection scans by shared suffix lengths.

Scans work on pairs of haplotypes: the shared suffix length of a pair at a variant is its
distance to the last variant where both are called and differ. ``suffixes`` has them by
blocks of variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varispark.operators.suffixes import first_differences, ihh_gaps, pair_stats, suffix_rows


def sequences(df: DataFrame, h: str = "h", by: tuple[str, ...] = ()) -> DataFrame:
    """(hidx, seq): the alleles of each haplotype along vidx [in each group of ``by``]."""
    long = df.select(*by, "vidx", F.posexplode(h).alias("hidx", "allele"))
    return long.groupBy(*by, "hidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("vidx", "allele"))), lambda x: x["allele"]).alias("seq"))


def distinct(df: DataFrame, h: str = "h") -> DataFrame:
    """Groups of identical haplotypes: members, count and frequency, largest first by ``rank``."""
    g = sequences(df, h).groupBy("seq").agg(F.array_sort(F.collect_list("hidx")).alias("members"), F.count("*").alias("count"))
    every = Window.partitionBy()
    return g.select("members", "count", (F.col("count") / F.sum("count").over(every)).alias("frequency"), F.row_number().over(Window.orderBy(F.desc("count"), "members")).alias("rank"))


def prefix_argsort(df: DataFrame, h: str = "h") -> DataFrame:
    """(rank, hidx): haplotypes in lexicographic order of their alleles."""
    return sequences(df, h).select((F.row_number().over(Window.orderBy("seq", "hidx")) - 1).alias("rank"), "hidx")


def _garud(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    f = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    ranked = counts.withColumn("f", f).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"))))
    top = lambda k: F.sum(F.when(F.col("r") <= k, F.col("f")).otherwise(0.0))
    rest = lambda k: F.sum(F.when(F.col("r") > k, F.col("f") * F.col("f")).otherwise(0.0))
    h1 = F.sum(F.col("f") * F.col("f"))
    n = F.sum("n")
    return ranked.groupBy(*by).agg(h1.alias("h1"), (top(2) * top(2) + rest(2)).alias("h12"), (top(3) * top(3) + rest(3)).alias("h123"), F.try_divide(rest(1), h1).alias("h2_h1"), F.when(n > 1, (1 - h1) * n / (n - 1)).alias("diversity"))


def garud_h(df: DataFrame, h: str = "h") -> DataFrame:
    """H1, H12, H123, H2/H1 and haplotype diversity."""
    return _garud(sequences(df, h).groupBy("seq").agg(F.count("*").alias("n")), ())


def moving_garud_h(df: DataFrame, size: int, h: str = "h", start: int = 0, stop: int | None = None, step: int | None = None) -> DataFrame:
    """The same for each full index window ``w``."""
    return _garud(_window_sequences(df, size, h, start, stop, step).groupBy("w", "seq").agg(F.count("*").alias("n")), ("w",))


def _window_sequences(df: DataFrame, size: int, h: str, start: int, stop: int | None, step: int | None) -> DataFrame:
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("vidx") - start - (size - 1)) / F.lit(step or size)).cast("bigint"))
    high = F.floor((F.col("vidx") - start) / F.lit(step or size)).cast("bigint")
    rows = df.where(F.col("vidx") >= start) if stop is None else df.where(F.col("vidx").between(start, stop - 1))
    rows = rows.select("vidx", h, F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))).alias("w"))
    return sequences(rows, h, ("w",)).where(F.size("seq") == size)


def haplotype_diversity(df: DataFrame, h: str = "h") -> DataFrame:
    return garud_h(df, h).select("diversity")


def moving_haplotype_diversity(df: DataFrame, size: int, h: str = "h", **kw) -> DataFrame:
    return moving_garud_h(df, size, h, **kw).select("w", "diversity")


def moving_hfs_rank(df: DataFrame, size: int, h: str = "h", start: int = 0, stop: int | None = None) -> DataFrame:
    """(w, slot, rank): slots of each window by haplotype group, larger groups first; singletons have rank 0."""
    g = _window_sequences(df, size, h, start, stop, None).groupBy("w", "seq").agg(F.count("*").alias("n"))
    order = Window.partitionBy("w").orderBy(F.desc("n"), "seq")
    g = g.withColumn("r", F.row_number().over(order)).withColumn("to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("w", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("slot"), F.when(F.col("n") > 1, F.col("r")).otherwise(0).alias("rank"))


#: Rows that one row is exploded to at once.
_RUN = 100_000


def ehh_decay(df: DataFrame, h: str = "h", truncate: bool = False) -> DataFrame:
    """(d, ehh): share of pairs identical over the first d variants, d from 0."""
    n, width = df.agg(F.count("*"), F.max(F.size(h))).first()
    pairs = (width or 0) * ((width or 0) - 1) // 2
    # at most one row a pair: where shares change
    steps = first_differences(df, h).groupBy("at").agg(F.count("*").alias("c"))
    steps = steps.unionByName(df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("c")))
    w = Window.orderBy("at")
    runs = steps.select("at", F.sum("c").over(w).alias("gone"), F.coalesce(F.lead("at").over(w), F.lit(n)).alias("to"))
    low, high = F.greatest(F.col("at"), F.lit(0)), F.col("to") - 1
    runs = runs.where(low <= high).select((F.lit(pairs) - F.col("gone")).alias("left"), low.alias("low"), high.alias("high"))
    runs = runs.withColumn("k", F.explode(F.sequence(F.floor(F.col("low") / _RUN), F.floor(F.col("high") / _RUN))))
    out = runs.select(F.explode(F.sequence(F.greatest("low", F.col("k") * _RUN), F.least("high", F.col("k") * _RUN + (_RUN - 1)))).alias("d"), F.try_divide(F.col("left"), F.lit(pairs)).alias("ehh"))
    return out.where("ehh > 0") if truncate else out


def neighbour_shared_prefix_lengths(df: DataFrame, h: str = "h", ordered: bool = True) -> DataFrame:
    """(rank, hidx, length): variants that each haplotype shares from the first on with the next one, by prefix order [or as they stand]."""
    width, n = df.agg(F.max(F.size(h)), F.count("*")).first()
    if ordered:
        order = prefix_argsort(df, h)
    else:
        order = df.sparkSession.range(width or 0).select(F.col("id").alias("rank"), F.col("id").cast("int").alias("hidx"))
    after = order.select((F.col("rank") - 1).alias("rank"), F.col("hidx").alias("next"))
    pairs = order.join(after, "rank").select("rank", "hidx", F.least("hidx", "next").alias("i"), F.greatest("hidx", "next").alias("j"))
    return pairs.join(first_differences(df, h), ["i", "j"], "left").select("rank", "hidx", F.coalesce("at", F.lit(n)).alias("length"))


def _colours(shared: list[int], n_variants: int) -> list[tuple[int, int, int, int]]:
    """(rank, from, to, colour) of sorted haplotypes whose neighbours share ``shared`` variants; colour 0 is unpainted."""
    n = len(shared) + 1
    since, colour = [0] * n, [1] * n
    out: list[tuple[int, int, int, int]] = []

    def paint(ranks: range, v: int, c: int) -> None:
        for k in ranks:
            if v > since[k]:
                out.append((k, since[k], v - 1, colour[k]))
            since[k], colour[k] = v, c

    groups, fresh = [range(n)], 2
    for v in sorted({x for x in shared if x < n_variants}):
        then = []
        for g in groups:
            cut = next((k + 1 for k in g[:-1] if shared[k] == v), None)
            if cut is None:
                then.append(g)
                continue
            parts = [range(g.start, cut), range(cut, g.stop)]
            major = int(len(parts[1]) > len(parts[0]))
            for which, part in enumerate(parts):
                if len(part) == 1:
                    paint(part, v, 0)
                    continue
                if which != major:
                    paint(part, v, fresh)
                    fresh += 1
                then.append(part)
        groups = then
    paint(range(n), n_variants, 0)
    return out


def voight_painting(df: DataFrame, h: str = "h") -> DataFrame:
    """(vidx, rank, hidx, colour): haplotypes in prefix order, each shared prefix in a colour of its own, 0 where none is shared.

    At a split the larger side (of equal ones that with allele 0) keeps the colour. The
    splits number less than the haplotypes; they are walked on the driver, rows are made on the executors.
    """
    low, high, n, width = df.agg(F.min(F.array_min(h)), F.max(F.array_max(h)), F.count("*"), F.max(F.size(h))).first()
    if n and (low < 0 or high > 1):
        raise NotImplementedError("only called biallelic variants can be painted")
    shared = [r["length"] for r in neighbour_shared_prefix_lengths(df, h).orderBy("rank").collect()] if width else []
    spark = df.sparkSession
    runs = spark.createDataFrame(_colours(shared, n) if width else [], "rank bigint, low bigint, high bigint, colour int")
    runs = runs.withColumn("k", F.explode(F.sequence(F.floor(F.col("low") / _RUN), F.floor(F.col("high") / _RUN))))
    cells = runs.select("rank", "colour", F.explode(F.sequence(F.greatest("low", F.col("k") * _RUN), F.least("high", F.col("k") * _RUN + (_RUN - 1)))).alias("vidx"))
    return cells.join(prefix_argsort(df, h), "rank").select("vidx", "rank", "hidx", "colour")


def shared_suffix_lengths(df: DataFrame, h: str = "h", reverse: bool = False, by_class: bool = True) -> DataFrame:
    """(vidx, i, j, cls, ssl), scanning forwards or backwards; missing alleles count as matches."""
    return suffix_rows(df, h, reverse, by_class)


def nsl(df: DataFrame, h: str = "h") -> DataFrame:
    """(vidx, nsl): log of the ratio of mean shared suffix lengths, allele 1 over allele 0, both directions added."""
    s = pair_stats(df, h, by_class=True)
    mean = lambda c: F.try_divide(F.col(f"fssl{c}"), F.col(f"fn{c}")) + F.try_divide(F.col(f"rssl{c}"), F.col(f"rn{c}"))
    r = F.try_divide(mean(1), mean(0))
    return s.select("vidx", F.when(r > 0, F.ln(r)).alias("nsl"))


def xpnsl(df: DataFrame, h1: str, h2: str) -> DataFrame:
    """(vidx, xpnsl): log of the ratio of mean shared suffix lengths of two populations."""
    a, b = (pair_stats(df, h, by_class=False).select("vidx", F.try_divide(F.col("fssl0") + F.col("rssl0"), F.col("fn0")).alias(c)) for c, h in (("a", h1), ("b", h2)))
    r = F.try_divide("a", "b")
    return a.join(b, "vidx").select("vidx", F.when(r > 0, F.ln(r)).alias("xpnsl"))


def ihs(df: DataFrame, h: str = "h", pos: str = "pos", map_pos: str | None = None, min_ehh: float = 0.05, min_maf: float = 0.05, include_edges: bool = False, gap_scale: int | None = 20_000, max_gap: int | None = 200_000, accessible: DataFrame | None = None) -> DataFrame:
    """(vidx, ihs): unstandardised log of integrated haplotype homozygosity, allele 1 over allele 0."""
    gaps = ihh_gaps(df, pos, map_pos, gap_scale, max_gap, accessible)
    both = pair_stats(df, h, True, gaps, min_ehh, include_edges)
    c0, c1 = F.size(F.filter(h, lambda a: a == 0)), F.size(F.filter(h, lambda a: a == 1))
    maf = F.try_divide(F.least(c0, c1).cast("double"), (c0 + c1).cast("double"))
    r = F.try_divide(F.col("fihh1") + F.col("rihh1"), F.col("fihh0") + F.col("rihh0"))
    out = df.select("vidx", maf.alias("maf")).join(both, "vidx", "left")
    return out.select("vidx", F.when((F.col("maf") >= min_maf) & (r > 0), F.ln(r)).alias("ihs"))


def xpehh(df: DataFrame, h1: str, h2: str, pos: str = "pos", map_pos: str | None = None, min_ehh: float = 0.05, include_edges: bool = False, gap_scale: int | None = 20_000, max_gap: int | None = 200_000, accessible: DataFrame | None = None) -> DataFrame:
    """(vidx, xpehh): log of the ratio of two populations' integrated haplotype homozygosity."""
    gaps = ihh_gaps(df, pos, map_pos, gap_scale, max_gap, accessible)
    a, b = (pair_stats(df, h, False, gaps, min_ehh, include_edges).select("vidx", (F.col("fihh0") + F.col("rihh0")).alias(c)) for c, h in (("a", h1), ("b", h2)))
    r = F.try_divide("a", "b")
    return a.join(b, "vidx").select("vidx", F.when(r > 0, F.ln(r)).alias("xpehh"))


def standardize(df: DataFrame, score: str, out: str = "z") -> DataFrame:
    """(x - mean) / population standard deviation, undefined scores left out."""
    stats = df.agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.try_divide(F.col(score) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def make_similar_sized_bins(df: DataFrame, value: str, n: int) -> list[float]:
    """Strictly rising edges at every (rows / n)-th sorted value; the last is the maximum."""
    total = df.count()
    step = max(1, total // n)
    ranked = df.select(value, (F.row_number().over(Window.orderBy(value)) - 1).alias("r")).where(F.col("r") % step == 0)
    edges: list[float] = []
    for r in ranked.orderBy("r").select(value).toLocalIterator():
        if not edges or r[0] > edges[-1]:
            edges.append(r[0])
    top = df.agg(F.max(value)).first()[0]
    if len(edges) > 1:
        edges[-1] = top
    return edges


def standardize_by_allele_count(df: DataFrame, score: str, aac: str, bins: list[float] | None = None, n_bins: int | None = None, out: str = "z") -> DataFrame:
    """Scores standardised within bins of allele counts.

    Mean and deviation of a bin are those of the scores between its edges (the last bin
    has both); scores beyond the outer edges are put into the outer bins. Without bins,
    half the largest count tells how many are made.
    """
    if bins is None:
        n = n_bins or max(1, (df.agg(F.max(aac)).first()[0] or 0) // 2)
        bins = make_similar_sized_bins(df.where(F.col(score).isNotNull()), aac, n)
    b: Column = F.lit(0)
    for e in bins[1:-1]:
        b = b + F.when(F.col(aac) >= e, 1).otherwise(0)
    rows = df.withColumn("_b", b)
    # one row a bin
    stats = rows.where(F.col(aac).between(bins[0], bins[-1])).groupBy("_b").agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    rows = rows.join(F.broadcast(stats), "_b", "left")
    return rows.withColumn(out, F.try_divide(F.col(score) - F.col("_m"), F.col("_s"))).drop("_b", "_m", "_s")
