"""Hand-computed values of small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varispark.functions import calls as G
from varispark.functions import counts as C
from varispark.operators import differentiation as D
from varispark.operators import diversity as V
from varispark.operators import genotypes as T
from varispark.operators import haplotypes as H
from varispark.operators import index as I
from varispark.operators import pairs as P
from varispark.operators import pedigree as M
from varispark.operators import runs as R
from varispark.operators import spectrum as S
from varispark.operators import windows as W
from varispark.plans.expressions import query, to_column, variables


def counts(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, i + 1, *[list(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "vidx bigint, pos bigint, " + ", ".join(f"{k} array<bigint>" for k in columns))


def values(df, *cols, order="vidx"):
    out = [tuple(r[c] for c in cols) for r in df.orderBy(order).collect()]
    return [x[0] for x in out] if len(cols) == 1 else out


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-7), (got, want)


def test_index_windows_and_moving_sums(spark):
    df = spark.createDataFrame(list(enumerate([2, 5, 8, 16])), "vidx bigint, x bigint")
    assert values(W.moving(df, {"s": F.sum("x")}, 2), "s", order="w") == [7, 24]
    assert values(W.moving(df, {"s": F.sum("x")}, 2, step=1), "s", order="w") == [7, 13, 24]
    assert W.index_windows(10, 4) == [(0, 4), (4, 8)]


def test_position_windows(spark):
    assert W.position_windows(10, 1, 27) == [(1, 10), (11, 20), (21, 27)]
    assert W.position_windows(10, 5, 5) == [] and W.position_windows(10, 1, 11) == [(1, 11)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([1, 12, 15, 27])], "vidx bigint, pos bigint")
    assert values(W.windowed_count(df, 10), "n", "window_start", "window_stop", order="w") == [(1, 1, 10), (2, 11, 20), (1, 21, 27)]


def test_position_windows_against_definition(spark):
    import random

    r = random.Random(3)
    for _ in range(6):
        start, size = r.randrange(1, 20), r.randrange(1, 15)
        stop, step = start + r.randrange(0, 60), r.randrange(1, 20)
        pos = sorted(r.sample(range(1, 100), 30))
        df = spark.createDataFrame([(i, p) for i, p in enumerate(pos)], "vidx bigint, pos bigint")
        want = [(sum(a <= p <= b for p in pos), a, b) for a, b in W.position_windows(size, start, stop, step)]
        assert values(W.windowed_count(df, size, start, stop, step), "n", "window_start", "window_stop", order="w") == want


def test_pairwise_difference(spark):
    df = counts(spark, ac=[(4, 0), (3, 1), (2, 2), (1, 3), (0, 4), (1, 1), (0, 0), (1, 0)])
    close(values(df.select("vidx", C.mean_pairwise_difference(F.col("ac")).alias("m")), "m"), [0, 3 / 6, 4 / 6, 3 / 6, 0, 1, None, None])
    wide = counts(spark, a=[(2, 0), (1, 1)], b=[(0, 2, 0), (0, 0, 2)])
    close(values(wide.select("vidx", C.mean_pairwise_difference_between(F.col("a"), F.col("b")).alias("m")), "m"), [1, 1])


def test_sequence_divergence(spark):
    df = counts(spark, a=[(2, 0), (2, 0), (2, 0)], b=[(0, 2), (0, 2), (0, 2)]).withColumn("pos", F.element_at(F.array(F.lit(2), F.lit(4), F.lit(8)), (F.col("vidx") + 1).cast("int")))
    close([V.sequence_divergence(df, "a", "b").first()[0]], [3 / 7])
    close([V.sequence_divergence(df, "a", "b", start=0, stop=5).first()[0]], [2 / 6])


def test_sfs(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (1,)], "dac int")
    assert values(S.sfs(df, "dac"), "count", order="k") == [1, 2, 1]
    assert values(S.sfs(df, "dac", 3), "count", order="k") == [1, 2, 1, 0]
    with pytest.raises(ValueError):
        S.sfs(df, "dac", 1)
    s = spark.createDataFrame([(k, 10 ** k) for k in range(5)], "k bigint, count bigint")
    assert values(S.fold_sfs(s, 4), "count", order="k") == [1 + 1000, 10 + 100]


GT = [[(0, 0), (0, 1), (-1, -1)], [(0, 2), (1, 1), (-1, -1)], [(1, 0), (2, 1), (-1, -1)], [(2, 2), (-1, -1), (-1, -1)], [(-1, -1), (-1, -1), (-1, -1)]]


def genotypes(spark, gt=GT):
    return spark.createDataFrame([(i, [list(c) for c in row]) for i, row in enumerate(gt)], "vidx bigint, gt array<array<tinyint>>")


def test_calls(spark):
    df = genotypes(spark)
    g = F.col("gt")
    one = lambda c: values(df.select("vidx", c.alias("x")), "x")
    assert one(G.is_called(g)) == [[True, True, False], [True, True, False], [True, True, False], [True, False, False], [False] * 3]
    assert one(G.count_true(G.is_het(g))) == [1, 1, 2, 0, 0]
    assert one(G.count_true(G.is_het(g, 2))) == [0, 1, 1, 0, 0]
    assert one(G.count_true(G.is_hom(g))) == [1, 1, 0, 1, 0] and one(G.count_true(G.is_hom_alt(g))) == [0, 1, 0, 1, 0]
    assert one(G.count_true(G.is_call(g, (1, 0)))) == [0, 0, 1, 0, 0]
    assert one(G.to_gt(g))[2] == ["1/0", "2/1", "./."]
    assert one(G.unpack_diploid(G.pack_diploid(g))) == [[list(c) for c in row] for row in GT]
    assert one(G.pack_diploid(g))[0] == [0, 1, 239]
    assert values(T.count_alleles(df), "ac") == [[3, 1, 0], [1, 2, 1], [1, 2, 1], [0, 0, 2], [0, 0, 0]]
    assert values(T.count_alleles(df, 1, [0, 0]), "ac") == [[4, 0], [2, 0], [2, 2], [0, 0], [0, 0]]
    assert [list(map(list, x)) for x in values(T.to_wide(T.to_long(df)), "gt")] == [[list(c) for c in row] for row in GT]
    h = df.select("vidx", F.flatten("gt").alias("h"))
    assert one(G.to_genotypes(F.flatten(g))) == [[list(c) for c in row] for row in GT]
    assert values(T.from_sparse(T.to_sparse(h), 5, 6), "h") == values(h, "h")
    assert values(T.compress_samples(df, [True, False, True]), "gt")[1] == [[0, 2], [-1, -1]]
    assert values(T.concatenate_samples(df, df), "gt")[0] == [[0, 0], [0, 1], [-1, -1]] * 2
    assert T.concatenate_variants(df, df).agg(F.max("vidx")).first()[0] == 9
    assert values(T.take_variants(df, [3, 0, 3]), "gt")[1] == [[0, 0], [0, 1], [-1, -1]]


def test_heterozygosity(spark):
    df = genotypes(spark, [[(0, 0), (0, 0)], [(0, 0), (0, 1)], [(0, 1), (1, 2)], [(0, -1), (-1, -1)], [(0, 1), (-1, -1)]])
    close(values(T.heterozygosity_observed(df), "ho"), [0, 0.5, 1, None, 1])


def test_rogers_huff(spark):
    rows = [[0, 1, 2], [0, 1, 2], [2, 1, 0], [1, 1, 1], [-1, -1, -1]]
    df = spark.createDataFrame(list(enumerate(rows)), "vidx bigint, gn array<int>")
    got = {(r.i, r.j): r.r for r in P.rogers_huff_r(df).collect()}
    close([got[0, 1], got[0, 2], got[0, 3], got[0, 4]], [1, -1, None, None])
    assert {(r.i, r.j) for r in P.rogers_huff_r(df, within=2).collect()} == {(i, j) for i in range(5) for j in range(i + 1, 5) if j - i <= 2}
    assert values(P.locate_unlinked(df, 10, 5, 0.5), "keep") == [True, False, False, True, True]


def test_admixture(spark):
    df = counts(spark, a=[(0, 2), (2, 0), (1, 1), (0, 0)], b=[(0, 2), (0, 2), (1, 1), (0, 2)])
    close(values(df.select("vidx", C.patterson_f2(F.col("a"), F.col("b")).alias("x")), "x"), [0, 1, -0.5, None])
    d = counts(spark, a=[(0, 2), (2, 0), (2, 0), (1, 1), (0, 0)], b=[(0, 2), (0, 2), (0, 2), (1, 1), (0, 2)], c=[(0, 2), (2, 0), (0, 2), (1, 1), (0, 2)], d=[(0, 2), (0, 2), (2, 0), (1, 1), (0, 2)])
    n, m = C.patterson_d(*[F.col(x) for x in "abcd"])
    got = values(d.select("vidx", n.alias("n"), m.alias("m")), "n", "m")
    close([x for x, _ in got], [0, 1, -1, 0, None])
    close([x for _, x in got], [0, 1, 1, 0.25, None])


def test_pbs(spark):
    df = counts(spark, a=[(2, 0)] * 5, b=[(1, 1)] * 5, c=[(0, 2)] * 5)
    got = values(D.pbs(df, "a", "b", "c", 2, step=1, normed=False), "pbs", order="w")
    assert len(got) == 4 and all(x is not None for x in got)


def test_jackknife_leaves_error_undefined(spark):
    blocks = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 2.0), (2, 3.0, 2.0)], "w bigint, n double, d double")
    got = D.jackknife_ratio(blocks, "n", "d").first()
    close([got.estimate, got.se], [1.0, math.sqrt(2 / 3 * 2 * 0.25**2)])


def test_ihs_on_two_sweeps(spark):
    """A constructed sweep: the value at the centre is ln(5.5 / 1.5)."""
    n = 19
    left = np.zeros((n, 5), int)
    right = np.ones((n, 5), int)
    for i in range(9):
        left[i, : min(5, 9 - i)] = 0
    df = spark.createDataFrame([(i, i + 1, [int(x) for x in [*left[i], *right[i]]]) for i in range(n)], "vidx bigint, pos bigint, h array<int>")
    got = H.ihs(df, include_edges=True, min_maf=0.0).where("vidx = 9").first().ihs
    assert abs(got) < 1e-9  # both classes alike
    close(values(H.nsl(df), "nsl")[9:10], [0.0])


def brute_ihh(h, gaps, i, min_ehh, edges, cls):
    cols = [j for j in range(h.shape[1]) if cls is None or h[i, j] == cls]
    pairs = [(a, b) for x, a in enumerate(cols) for b in cols[x + 1 :]]
    if not pairs:
        return None

    def length(a, b):
        k = i
        while k >= 0 and h[k, a] == h[k, b]:
            k -= 1
        return i - k

    ssl = [length(a, b) for a, b in pairs]
    prev = sum(s > 0 for s in ssl) / len(ssl)
    if prev <= min_ehh:
        return 0.0
    total = 0.0
    for step in range(1, i + 1):
        ehh = sum(s > step for s in ssl) / len(ssl)
        total += gaps[i - step] * (ehh + prev) / 2
        if ehh <= min_ehh:
            return total
        prev = ehh
    return total if edges else None


def test_ihs_against_definition(spark):
    r = np.random.default_rng(5)
    h = r.integers(0, 2, (25, 8))
    pos = np.cumsum(r.integers(1, 9, 25))
    df = spark.createDataFrame([(i, int(pos[i]), h[i].tolist()) for i in range(25)], "vidx bigint, pos bigint, h array<int>")
    gaps = np.diff(pos).astype(float)
    for edges in (False, True):
        want = []
        for i in range(25):
            f = [brute_ihh(h, gaps, i, 0.05, edges, k) for k in (0, 1)]
            b = [brute_ihh(h[::-1], gaps[::-1], 24 - i, 0.05, edges, k) for k in (0, 1)]
            if None in f + b or f[0] + b[0] <= 0 or f[1] + b[1] <= 0:
                want.append(None)
            else:
                want.append(math.log((f[1] + b[1]) / (f[0] + b[0])))
        close(values(H.ihs(df, include_edges=edges, min_maf=0.0), "ihs"), want)


def test_identical_haplotypes(spark):
    df = spark.createDataFrame([(0, [0, 0, 1, 0]), (1, [1, 1, 0, 0])], "vidx bigint, h array<int>")
    assert values(H.distinct(df), "members", "count", order="rank") == [([0, 1], 2), ([2], 1), ([3], 1)]
    assert values(H.prefix_argsort(df), "hidx", order="rank") == [3, 0, 1, 2]
    close([H.haplotype_diversity(df).first()[0]], [(1 - (4 + 1 + 1) / 16) * 4 / 3])
    assert values(H.moving_hfs_rank(df, 2), "slot", "rank", order="slot") == [(0, 1), (1, 1), (2, 0), (3, 0)]


def test_mendel_and_phasing(spark):
    df = genotypes(spark, [[(0, 0), (1, 1), (0, 1), (0, 0)], [(0, 1), (0, 1), (2, 1), (1, 1)], [(0, 0), (0, 0), (1, 1), (0, 1)], [(-1, -1), (0, 0), (1, 1), (0, 0)], [(0, 1), (2, 2), (2, 0), (1, 2)]])
    assert values(df.select("vidx", M.mendel_errors(F.col("gt")).alias("e")), "e") == [[0, 1], [1, 0], [2, 1], [0, 0], [0, 0]]
    got = M.phase_progeny_by_transmission(df)
    assert values(got, "is_phased")[0] == [False, False, True, False]
    assert values(got, "gt")[4][2:] == [[0, 2], [1, 2]]
    done = M.phase_by_transmission(df, 5)
    assert values(done, "is_phased")[0][:2] == [True, True]


def test_painting(spark):
    rows = [([0, 0], [0, 1, -1, 0]), ([0, 1], [0, 1, 2, -1]), ([1, 1], [0, 1, 1, -1]), ([0, -1], [0, 1, -1, 0])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "vidx bigint, p array<int>, h array<int>")
    assert values(df.select("vidx", M.paint_transmission(F.col("p"), F.col("h")).alias("x")), "x") == [[3, 5, 7, 3], [1, 2, 5, 7], [5, 4, 4, 7], [6, 6, 7, 6]]


def test_runs(spark):
    df = spark.createDataFrame(list(enumerate([1, 1, 0, 1, 1, 2, 2, 0, 2, 1, 1])), "vidx bigint, s int")
    got = values(R.state_transitions(df, "s", [1, 2]), "lstate", "rstate", "lidx", "ridx", order="lidx")
    assert got == [(None, 1, -1, 0), (1, 2, 4, 5), (2, 1, 8, 9), (1, None, 10, -1)]
    got = values(R.state_blocks(df, "s", [1, 2]), "state", "support", "size_min", "size_max", "is_marginal", order="start_ridx")
    assert got == [(1, 4, 5, -1, True), (2, 3, 4, 4, False), (1, 2, 2, -1, True)]


def test_roh(spark):
    df = spark.createDataFrame([(p, [[0, 0]]) for p in (1, 10, 50, 100)], "pos bigint, gt array<array<tinyint>>")
    got = R.roh_mhmm(df, 100).collect()
    assert [(r.start, r.stop, r.froh) for r in got] == [(1, 100, 1.0)]
    het = [(p, [[0, 1] if 400 <= p <= 600 else [0, 0]]) for p in range(1, 1001, 5)]
    got = R.roh_poissonhmm(spark.createDataFrame(het, "pos bigint, gt array<array<tinyint>>"), 1000, phet_roh=0.001, phet_nonroh=(0.1, 0.2), window_size=50).orderBy("start").collect()
    assert len(got) == 2 and got[0].stop <= 420 and got[1].start >= 580


def test_pca_and_pcoa(spark):
    r = np.random.default_rng(1)
    g = r.integers(0, 3, (60, 8))
    df = spark.createDataFrame([(i, g[i].tolist()) for i in range(60)], "vidx bigint, gn array<int>")
    coords, model = P.pca(df, 3)
    x = g - g.mean(1, keepdims=True)
    p = g.mean(1, keepdims=True) / 2
    x = (x / np.sqrt(p * (1 - p))).T
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(coords), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    assert np.allclose(model.explained_variance_ratio_, (s**2 / (s**2).sum())[:3])
    again = np.array([v.pc for v in model.transform(df, df).orderBy("sidx").collect()])
    assert np.allclose(again, coords, atol=1e-6)
    d = P.pairwise_distance(df)
    points, ratio = P.pcoa(d, 8)
    want = np.sqrt(((g.T[:, None] - g.T[None]) ** 2).sum(2))
    assert np.allclose(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), want, atol=1e-6) and abs(ratio.sum() - 1) < 1e-9


def test_condensed_coordinates():
    n = 5
    order = [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert [P.condensed_coords(i, j, n) for i, j in order] == list(range(10))
    assert P.condensed_coords_within([0, 2, 4], n) == [order.index(x) for x in ((0, 2), (0, 4), (2, 4))]
    with pytest.raises(ValueError):
        P.condensed_coords(1, 1, n)


def test_indexes(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([3, 6, 6, 11])], "vidx bigint, pos bigint")
    assert I.is_sorted(df, "pos") and not I.is_unique(df, "pos")
    assert values(I.locate_key(df, pos=6), "vidx") == [1, 2]
    with pytest.raises(KeyError):
        I.locate_key(df, pos=7)
    with pytest.raises(KeyError):
        I.locate_keys(df, spark.createDataFrame([(3,), (4,)], "pos bigint"), "pos")
    with pytest.raises(KeyError):
        I.locate_range(df, "pos", 7, 10)
    assert values(I.intersect_range(df, "pos", 4), "vidx") == [1, 2, 3]


def test_expressions(spark):
    df = spark.createDataFrame([(0, 35, 4.0), (1, 10, 9.0)], "vidx bigint, DP int, QD double")
    assert values(query(df, "(DP > 30) & (QD < 4.5)"), "vidx") == [0]
    assert variables("sqrt(DP) + QD") == ["DP", "QD"]
    with pytest.raises(ValueError):
        to_column("__import__('os')")


def test_scans_over_many_blocks(spark, monkeypatch):
    """Blocks of 7 variants and chunks of 5 pairs give what one block gives, and what the definition gives."""
    from varispark.operators import suffixes as X

    r = np.random.default_rng(3)
    n, width = 60, 9
    freq = r.uniform(0.02, 0.4, n)
    a = np.where(r.random((n, width)) < 0.05, -1, (r.random((n, width)) < freq[:, None]).astype(int))
    pos = np.cumsum(r.integers(1, 60, n))
    pos[40:] += 500
    df = spark.createDataFrame([(v, int(pos[v]), a[v].tolist()) for v in range(n)], "vidx long, pos long, h array<int>")
    kw = {"min_ehh": 0.1, "gap_scale": 30, "max_gap": 400}

    def ihh(v, cls, reverse, edges):
        order = np.arange(v, n) if reverse else np.arange(v, -1, -1)
        pairs = [(i, j) for i in range(width) for j in range(i + 1, width) if cls is None or a[v, i] == a[v, j] == cls]
        if not pairs:
            return None
        apart = lambda u, i, j: a[u, i] >= 0 and a[u, j] >= 0 and a[u, i] != a[u, j]
        ssl = [next((k for k, u in enumerate(order) if apart(u, i, j)), len(order)) for i, j in pairs]
        ehh = lambda k: sum(x > k for x in ssl) / len(ssl)
        total, before = 0.0, ehh(0)
        if before <= kw["min_ehh"]:
            return 0.0
        for k in range(1, len(order)):
            d = abs(int(pos[order[k]]) - int(pos[order[k - 1]]))
            if d > kw["max_gap"]:
                return None
            now = ehh(k)
            total += min(d, kw["gap_scale"]) * (now + before) / 2
            if now <= kw["min_ehh"]:
                return total
            before = now
        return total if edges else None

    for block in (7, 4096):
        monkeypatch.setattr(X, "BLOCK", block)
        monkeypatch.setattr(X, "CHUNK", 5 if block == 7 else 256)
        for edges in (False, True):
            gaps = X.ihh_gaps(df, gap_scale=kw["gap_scale"], max_gap=kw["max_gap"])
            for by_class in (True, False):
                got = {x.vidx: x for x in X.pair_stats(df, "h", by_class, gaps, kw["min_ehh"], edges).collect()}
                assert len(got) == n
                for v in range(n):
                    for d in (0, 1):
                        for c in (0, 1) if by_class else (None,):
                            want, have = ihh(v, c, d, edges), got[v]["fr"[d] + f"ihh{c or 0}"]
                            assert (want is None) == (have is None) and (want is None or abs(want - have) < 1e-9), (block, edges, v, d, c, want, have)


def test_gaps_by_accessible_bases(spark):
    df = spark.createDataFrame([(0, 1), (1, 11), (2, 31)], "vidx long, pos long")
    mask = spark.createDataFrame([(1, 5), (21, 40)], "start long, stop long")
    got = {x.vidx: x.gap for x in H.ihh_gaps(df, accessible=mask).collect()}
    assert got == {0: 5.0, 1: 10.0, 2: None}


def test_standardisation_fits_between_the_edges(spark):
    rows = [(0, 1.0), (1, 2.0), (2, 4.0), (3, 1.0), (4, 5.0), (5, 9.0), (6, 100.0)]
    df = spark.createDataFrame([(a, s) for a, s in rows], "aac long, score double")
    got = {x.aac: x.z for x in H.standardize_by_allele_count(df, "score", "aac", bins=[1, 3, 5]).collect()}
    low, high = [2.0, 4.0], [1.0, 5.0, 9.0]
    for a, s in rows:
        of = low if a < 3 else high
        assert abs(got[a] - (s - np.mean(of)) / np.std(of)) < 1e-9


def test_distances_of_every_metric(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 3, (40, 6)).astype(float)
    df = spark.createDataFrame([(v, x[v].tolist()) for v in range(40)], "vidx long, gn array<double>").repartition(4)
    centred = lambda a: a - a.mean()
    cos = lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b))
    want = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()),
        "sqeuclidean": lambda a, b: ((a - b) ** 2).sum(),
        "cityblock": lambda a, b: np.abs(a - b).sum(),
        "chebyshev": lambda a, b: np.abs(a - b).max(),
        "hamming": lambda a, b: (a != b).mean(),
        "canberra": lambda a, b: sum(abs(p - q) / (abs(p) + abs(q)) for p, q in zip(a, b, strict=True) if p or q),
        "braycurtis": lambda a, b: np.abs(a - b).sum() / np.abs(a + b).sum(),
        "cosine": cos,
        "correlation": lambda a, b: cos(centred(a), centred(b)),
    }
    for name, f in want.items():
        got = {(d.i, d.j): d.distance for d in P.pairwise_distance(df, metric=name).collect()}
        assert len(got) == 15 and all(abs(got[i, j] - f(x[:, i], x[:, j])) < 1e-9 for i, j in got), name
    own = {(d.i, d.j): d.distance for d in P.pdist(df, metric=lambda a, b: float((a * np.arange(40) - b).sum())).collect()}
    assert own == {(i, j): float((x[:, i] * np.arange(40) - x[:, j]).sum()) for i in range(6) for j in range(i + 1, 6)}


def test_painting_against_prefixes(spark):
    r = np.random.default_rng(8)
    a = (r.random((12, 10)) < 0.3).astype(int)
    a[:, 3] = a[:, 7]
    df = spark.createDataFrame([(v, a[v].tolist()) for v in range(12)], "vidx long, h array<int>")
    got = {(x.vidx, x.hidx): x.colour for x in H.voight_painting(df).collect()}
    assert len(got) == 120
    order = sorted(range(10), key=lambda k: (a[:, k].tolist(), k))
    want, colour, fresh = {}, {k: 1 for k in range(10)}, 2
    for v in range(12):
        groups: dict[tuple, list[int]] = {}
        for k in order:
            groups.setdefault(tuple(a[:v, k]), []).append(k)
        for members in groups.values():
            parts = [[k for k in members if a[v, k] == x] for x in (0, 1)]
            if all(parts):
                major = int(len(parts[1]) > len(parts[0]))
                for x, part in enumerate(parts):
                    if len(part) == 1:
                        colour[part[0]] = 0
                    elif x != major:
                        for k in part:
                            colour[k] = fresh
                        fresh += 1
        want |= {(v, k): colour[k] for k in range(10)}
    assert got == want
    with pytest.raises(NotImplementedError):
        H.voight_painting(df.withColumn("h", F.transform("h", lambda x: x + 1)))


def test_jackknife_of_any_statistic(spark):
    x, y = [1.0, 4.0, 2.0, 8.0], [2.0, 2.0, 5.0, 4.0]
    df = spark.createDataFrame(list(zip(range(4), x, y, strict=True)), "w long, x double, y double")
    ratio = lambda a, b: a.sum() / b.sum()
    got = D.jackknife_of(df, ["x", "y"], ratio, "w").orderBy("k").collect()
    vj = [ratio(np.delete(x, k), np.delete(y, k)) for k in range(4)]
    close([g.vj for g in got], vj)
    close([got[0]["mean"], got[0].se], [np.mean(vj), np.sqrt(3 / 4 * np.sum((vj - np.mean(vj)) ** 2))])
    with pytest.raises(ValueError):
        D.jackknife_of(df, ["x"], np.mean, "w", most=3)


def base_by_base(start, move, emissions):
    score, back = start + emissions[0], []
    for e in emissions[1:]:
        m = score[:, None] + move
        back.append(m.argmax(0))
        score = m.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_roh_with_bases_that_are_not_observed(spark):
    n, hets = 400, [101, 104, 107, 110, 113, 250, 330, 333, 336]
    mask = [(1, 90), (100, 240), (245, 400)]
    df = spark.createDataFrame([(p, [[0, 1], [0, 0]]) for p in hets], "pos long, gt array<array<int>>")
    shown = np.zeros(n + 1, bool)
    for a, b in mask:
        shown[a : b + 1] = True
    het = np.array([0.001, 0.05, 0.3])
    e = np.log(R.emission_matrix(het, shown.sum() / n))
    rows = [e[:, 2] if not shown[p] else e[:, 1] if p in hets else e[:, 0] for p in range(1, n + 1)]
    path = base_by_base(np.log(np.full(3, 1 / 3)), np.log(R.transition_matrix(0.01, 3)), rows)
    inside = {p + 1 for p, s in enumerate(path) if s == 0}
    got = R.roh_mhmm(df, n, 0.001, (0.05, 0.3), 0.01, accessible=spark.createDataFrame(mask, "start long, stop long")).collect()
    first = [x for x in got if x.sidx == 0]
    assert {p for x in first for p in range(x.start, x.stop + 1)} == inside and abs(first[0].froh - len(inside) / n) < 1e-12
    assert [(x.start, x.stop, x.froh) for x in got if x.sidx == 1] == [(1, n, 1.0)]
    windows = R.roh_poissonhmm(df, n, 0.001, (0.05, 0.3), 0.01, window_size=20, accessible=spark.createDataFrame(mask, "start long, stop long")).where("sidx = 1").collect()
    assert [(x.start, x.stop) for x in windows] == [(1, 393)]


def test_samples_without_a_run_are_told(spark):
    df = spark.createDataFrame([(p, [[0, 1], [0, 0]]) for p in range(1, 101)], "pos long, gt array<array<int>>")
    got = {x.sidx: (x.start, x.froh) for x in R.roh_mhmm(df, 100, 0.001, (0.5,), 0.001).collect()}
    assert got == {0: (None, 0.0), 1: (1, 1.0)}


def test_scalers_and_randomised_pca(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 3, (200, 12))
    x[:, :6] = np.minimum(2, x[:, :6] + (r.random((200, 6)) < 0.4))
    df = spark.createDataFrame([(v, x[v].tolist()) for v in range(200)], "vidx long, gn array<int>").repartition(3)
    exact, _ = P.pca(df, 2)
    near, model = P.randomized_pca(df, 2, random_state=1)
    assert np.allclose(np.abs(exact), np.abs(near), atol=1e-6) and model.samples_.shape == (12, 2)
    sd = x.std(1)
    want = {v: (x[v] - x[v].mean()) / sd[v] for v in range(200) if sd[v] > 0}
    got = {g.vidx: g.gn for g in P.get_scaler("standard").fit_transform(df).collect()}
    assert all(np.allclose(got[v], want[v]) if v in want else got[v] is None for v in range(200))
    half = df.withColumn("gn", F.slice("gn", 1, 3))
    fitted = P.get_scaler("center").fit(df).transform(half).where("vidx = 5").first().gn
    assert np.allclose(fitted, x[5, :3] - x[5].mean())
    with pytest.raises(ValueError):
        P.get_scaler("other")


def test_checks(spark):
    from pyspark.sql import types as T

    from varispark.functions import checks as K

    df = spark.createDataFrame([(0, [[0, 1], [0, 0]], [0, 1, 0], "x"), (1, [[0, 1], [1]], [0, 1], "y")], "vidx long, gt array<array<int>>, h array<int>, t string")
    K.check_ndim(df, "gt", 3)
    K.check_type(df, "gt", T.ArrayType)
    K.check_integer_dtype(df, "h")
    K.check_dtype(df, "h", "int")
    K.check_dtype_kind(df, "gt", T.NumericType)
    K.check_rows_aligned(df, df.select("vidx"))
    for bad in (lambda: K.check_ndim(df, "h", 3), lambda: K.check_type(df, "t", T.ArrayType), lambda: K.check_integer_dtype(df, "t"), lambda: K.check_dtype(df, "h", "tinyint"), lambda: K.check_dtype_kind(df, "t", T.NumericType)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        K.check_same_ndim(df, "gt", "h")
    with pytest.raises(ValueError):
        K.check_rows_aligned(df, df.where("vidx = 0"))
    one = df.where("vidx = 0")
    for c in (K.require_ploidy("gt", 2), K.require_samples("h", 3), K.require_length("h", 3), K.require_aligned("gt", F.slice("h", 1, 2))):
        assert len(one.select(c.alias("c")).first().c) > 1
        with pytest.raises(Exception, match="ploidy|samples|elements|length"):
            df.where("vidx = 1").select(K.require_aligned(c, F.lit([1, 2, 3])).alias("c")).collect()
