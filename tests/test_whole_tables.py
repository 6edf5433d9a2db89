"""Queries read whole tables: more parts, line items and events than any bound that once stood in them."""

import duckdb
import numpy as np
import pytest

from tests.test_queries import SF, TABLES, pytestmark, rows  # noqa: F401
from varispark.plans.queries import QUERIES, SQL

#: 300 parts fill the windows of 20, 25 and 3 variants.
PARTS = 300


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """The tables of sf0.001 with more parts."""
    d = tmp_path_factory.mktemp("whole")
    for t in TABLES:
        (d / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (d / "part.parquet").unlink()
    duckdb.sql(f"copy (select i p_partkey from range({PARTS}) t(i)) to '{d}/part.parquet' (format parquet)")
    return str(d)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def alleles(n: int = PARTS) -> np.ndarray:
    """The grid's alleles by variant and haplotype."""
    p, s, k = np.ogrid[:n, :20, :2]
    h = (p * 7919 + s * 104729 + k * 1299709 + p * s * 31) % 1009
    return np.where(h < 60, -1, np.where(h < 60 + (p * 37) % 900, 1, 0)).reshape(n, 40)


GRID = sorted(n for n, q in SQL.items() if " from part, range(" in q)


@pytest.mark.parametrize("name", GRID)
def test_grid_has_every_part(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["ihs", "xpehh", "xpnsl", "locate_unlinked"])
def test_scans_have_every_part(spark, sf, name):
    assert {x["vidx"] for x in QUERIES[name](spark, sf).select("vidx").collect()} == set(range(PARTS))


@pytest.mark.parametrize("name", ["roh_mhmm", "roh_poissonhmm"])
def test_roh_reaches_the_last_base(spark, sf, name):
    """The last run of some sample ends at the last base, which follows the parts."""
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) and got["stop"].max() == PARTS * 10


def breaks(a: np.ndarray, i: int, j: int) -> np.ndarray:
    """Variants where both haplotypes are called and differ."""
    return np.flatnonzero((a[:, i] >= 0) & (a[:, j] >= 0) & (a[:, i] != a[:, j]))


def test_rogers_huff_r_has_all_pairs(spark, sf):
    a = alleles().reshape(PARTS, 20, 2)
    gn = np.where((a < 0).any(2), -1, (a > 0).sum(2))
    got = {(x["i"], x["j"]): x["r"] for x in QUERIES["rogers_huff_r"](spark, sf).collect()}
    assert len(got) == PARTS * (PARTS - 1) // 2
    for (i, j), r in list(got.items())[::7]:
        on = (gn[i] >= 0) & (gn[j] >= 0)
        x, y = gn[i][on], gn[j][on]
        defined = len(x) and x.std() > 0 and y.std() > 0
        assert (r is not None) == bool(defined)
        assert not defined or abs(r - np.corrcoef(x, y)[0, 1]) < 1e-6


def test_all_r_over_many_blocks(spark, sf, monkeypatch):
    from varispark.operators import pairs as P
    from varispark.plans.queries import _gn
    from varispark.plans.views import grid_view

    df = _gn(grid_view(spark, sf)).where("vidx < 70")
    want = {(x["i"], x["j"]): x["r"] for x in P.rogers_huff_r(df, within=70).collect()}
    monkeypatch.setattr(P, "_BLOCK", 16)
    got = {(x["i"], x["j"]): x["r"] for x in P.rogers_huff_r(df).collect()}
    assert got.keys() == want.keys() and len(got) == 70 * 69 // 2
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-12) for k in got)


def test_r_is_rounded_in_blocks_as_spark_rounds(spark):
    """A row for each variant and block leaves the kernel, not one a pair; ties and signs are rounded as ``F.round`` does."""
    from pyspark.sql import functions as F

    from varispark.operators import pairs as P

    x = np.r_[[1 / 256, -1 / 256, 0.0, -1e-9, 1.0, 3 / 7, 0.12345675, -0.12345675, 0.00000015, 0.99999995], np.random.default_rng(1).uniform(-1, 1, 2000), np.random.default_rng(2).integers(-(10**7), 10**7, 2000) / 10**7 + 5e-8]
    want = [r["y"] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 7).alias("y")).collect()]
    got = P._rounded(x, 7).tolist()
    assert list(map(repr, got)) == list(map(repr, want))


def test_sequential_kernels_take_rows_by_batches(spark):
    """Rows of a group come in order and in many batches, and no worker sees them all at once."""
    from varispark.operators import pairs as P
    from varispark.operators import pedigree as M

    r = np.random.default_rng(4)
    gn = r.integers(-1, 3, (400, 6))
    rows = [(v, "ab"[v % 2], gn[v].tolist(), [[[0, 1], [1, 1]], [[0, 1], [0, 1]]][v % 2] + r.integers(-1, 2, (5, 2)).tolist()) for v in r.permutation(400).tolist()]
    df = spark.createDataFrame(rows, "vidx bigint, chrom string, gn array<int>, gt array<array<tinyint>>")

    def keep(rows):
        keep = [True] * len(rows)
        for a in range(0, len(rows), 10):
            for i in range(a, min(a + 30, len(rows))):
                for j in range(max(i + 1, a + 20 if a else 0), min(a + 30, len(rows))):
                    v = P._r(rows[i].astype(float), rows[j].astype(float)) if keep[i] and keep[j] else 0.0
                    keep[j] = keep[j] and not v * v > 0.5
        return keep

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    once = [q.orderBy("vidx").collect() for q in (P.locate_unlinked(df, 30, 10, 0.5), M.phase_by_transmission(df, 4), M.phase_by_transmission(df, 4, by="chrom"))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        many = [q.orderBy("vidx").collect() for q in (P.locate_unlinked(df, 30, 10, 0.5), M.phase_by_transmission(df, 4), M.phase_by_transmission(df, 4, by="chrom"))]
        by = {x["vidx"]: x["keep"] for x in P.locate_unlinked(df, 30, 10, 0.5, by="chrom").collect()}
        plans = [q._jdf.queryExecution().toString() for q in (P.locate_unlinked(df), M.phase_by_transmission(df, 4))]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert once == many and [x["keep"] for x in many[0]] == keep(gn)
    assert [by[v] for v in range(0, 400, 2)] == keep(gn[::2]) and [by[v] for v in range(1, 400, 2)] == keep(gn[1::2])
    assert all("FlatMapGroupsInPandas" not in p for p in plans)


def test_haplotype_distinct_has_all_variants(spark, sf):
    groups: dict[bytes, int] = {}
    for h in alleles().astype("int8").T:
        groups[h.tobytes()] = groups.get(h.tobytes(), 0) + 1
    got = {x["count"]: x["groups"] for x in QUERIES["haplotype_distinct"](spark, sf).collect()}
    assert got == {c: list(groups.values()).count(c) for c in groups.values()}


def test_ehh_decay_has_all_variants(spark, sf):
    a = alleles()
    first = [next(iter(np.flatnonzero(a[:, i] != a[:, j])), PARTS) for i in range(40) for j in range(i + 1, 40)]
    got = {x["d"]: x["ehh"] for x in QUERIES["ehh_decay"](spark, sf).collect()}
    assert got == {d: round(sum(f > d for f in first) / len(first), 9) for d in range(PARTS)}


def test_moving_garud_h_has_all_windows(spark, sf):
    assert {x["w"] for x in QUERIES["moving_garud_h"](spark, sf).collect()} == set(range(PARTS // 3))


def test_suffix_lengths_and_nsl_have_all_haplotypes(spark, sf):
    a = alleles()
    v = np.arange(PARTS)
    ssl, sums = {}, np.zeros((2, PARTS))
    pairs = np.zeros((2, PARTS))
    for i in range(40):
        for j in range(i + 1, 40):
            b = breaks(a, i, j)
            before, after = np.r_[-1, b][np.searchsorted(b, v, "right")], np.r_[b, PARTS][np.searchsorted(b, v)]
            ssl[i, j] = v - before
            for c in (0, 1):
                on = (a[:, i] == c) & (a[:, j] == c)
                sums[c] += np.where(on, after - before, 0)
                pairs[c] += on
    got = QUERIES["shared_suffix_lengths"](spark, sf).toPandas()
    assert len(got) == PARTS * 780
    assert all((g["ssl"].to_numpy() == ssl[k]).all() for k, g in got.sort_values("vidx").groupby(["i", "j"]))
    nsl = {x["vidx"]: x["nsl"] for x in QUERIES["nsl"](spark, sf).collect()}
    for k in range(PARTS):
        defined = pairs[0, k] and pairs[1, k]
        assert (nsl[k] is not None) == bool(defined)
        assert not defined or abs(nsl[k] - np.log(sums[1, k] / pairs[1, k] / (sums[0, k] / pairs[0, k]))) < 1e-6


SF01 = SF.replace("sf0.001", "sf0.01")  # 2,000 positions
LAST = 2000


@pytest.fixture(scope="module")
def positions():
    return [x + 1 for (x,) in duckdb.sql(f"select distinct l_partkey from '{SF01}/lineitem.parquet'").fetchall()]


@pytest.mark.parametrize("name", ["sequence_divergence", "windowed_given", "index_intersect", "index_locate_keys", "index_intersect_ranges", "index_ranges_with_rows", "feature_mask", "fold_sfs", "fold_joint_sfs", "windowed_count"])
def test_sql_of_a_larger_table(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF01}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF01).toPandas()) == rows(con.sql(SQL[name]).df())


def test_windows_keys_and_features_reach_the_last_position(spark, sf):
    """Over 6,000 positions, more than the constants of the SQL reach."""
    from pyspark.sql import functions as F

    from varispark.plans import queries as Q

    long = spark.range(3000).select((F.col("id") * 2 + 1).alias("pos"))
    assert Q._until_last(long, 7).count() == 5999 // 7 + 1
    assert Q._until_last(long, 37, 1, least=20).count() == 5998 // 37 + 1
    assert Q._until_last(long.limit(3), 13, 1, least=90).count() == 90
    got = Q._ranges(long).agg(F.max("start")).first()[0]
    assert 5999 - 61 < got <= 5999


def test_long_windows_are_made_of_few_blocks(spark):
    """Blocks give what every row with every window gives; rows of the join follow the logarithm of a window's length."""
    from pyspark.sql import functions as F

    from varispark.operators import windows as W

    df = spark.range(-300, 9000, 3).select(F.col("id").alias("pos"), (F.col("id") % 11).alias("v")).union(spark.sql("select null pos, 1L v"))
    bounds = [(0, -400, 20_000), (1, 5, 5), (2, 6, 6), (3, -7, 64), (4, 100, 4195), (5, 9, 3), (6, 9001, 9700), (7, None, 4)]
    windows = spark.createDataFrame([*bounds, *[(10 + i, i * 37 - 300, i * 41 - 290) for i in range(200)]], "w long, window_start long, window_stop long")
    how = {"s": F.sum("v"), "top": F.max("v")}
    want, got = (W.windowed_given(df, how, windows, bin_size=64, merge=m) for m in (None, {"s": F.sum, "top": F.max}))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "BroadcastHashJoin" not in W.windowed_given(df, how, windows)._jdf.queryExecution().sparkPlan().toString().split("Generate")[0]


def test_windows_and_features_at_sf001(spark, positions):
    got = {x["w"]: (x["window_start"], x["window_stop"], x["n"]) for x in QUERIES["windowed_given"](spark, SF01).collect()}
    want = {i: (i * 37 + 1, i * 40 + 5) for i in range((LAST - 1) // 37 + 1)}
    assert got == {i: (a, b, sum(a <= p <= b for p in positions)) for i, (a, b) in want.items()}
    covered = {p for i in range((LAST - 1) // 13 + 1) for p in range(i * 13 + 1, i * 13 + 1 + (i * 7) % 20 + 1)}
    union = [(x["start"], x["stop"]) for x in QUERIES["feature_mask"](spark, SF01).collect()]
    assert {p for a, b in union for p in range(a, b + 1)} == covered and sum(b - a + 1 for a, b in union) == len(covered)


@pytest.mark.parametrize("name", ["fold_sfs", "fold_joint_sfs"])
def test_folds_keep_high_counts(spark, tmp_path, name):
    """A part with 16 derived alleles in each of two populations, as one with none, is counted: no bin is left out."""
    for t in ("supplier", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    con = duckdb.connect()
    pop = lambda p: f"(select min(s_suppkey) from '{SF}/supplier.parquet' join '{SF}/nation.parquet' on s_nationkey = n_nationkey where n_regionkey = {p})"
    one = lambda part, p, flag, n: f"select {part}::bigint l_partkey, {pop(p)} l_suppkey, '{flag}' l_returnflag from range({n})"
    con.sql(" union all ".join([one(0, 0, "N", 16), one(0, 1, "N", 16), one(1, 0, "A", 3), one(1, 1, "A", 3)])).write_parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(v for k, v in sorted(x.asDict().items()) if k != "count"): x["count"] for x in QUERIES[name](spark, str(tmp_path)).collect()}
    both = 1 if name == "fold_sfs" else 2
    # n is 17: bin 16 mirrors to 1, bin 0 stays
    assert {k: c for k, c in got.items() if c} == {(1,) * both: 1, (0,) * both: 1}


def test_pairwise_dxy_per_accessible_base(spark):
    from varispark.operators import pairs as P

    df = spark.createDataFrame([(1, [[2, 0], [0, 2]]), (5, [[2, 0], [0, 2]]), (9, [[2, 0], [2, 0]])], "pos long, gac array<array<long>>")
    mask = spark.createDataFrame([(1, 3), (8, 20)], "start long, stop long")
    assert P.pairwise_dxy(df).first()["dxy"] == 2 / 9
    # of bases 1 to 10, 1-3 and 8-10 are accessible; the variant at 5 is not
    assert P.pairwise_dxy(df, start=1, stop=10, accessible=mask).first()["dxy"] == 1 / 6


def test_roh_mhmm_refuses_a_share_without_intervals(spark):
    """The share of accessible bases follows from the intervals; given alone it is refused, not ignored."""
    from varispark.operators import runs as R

    df = spark.createDataFrame([(1, [[0, 0]])], "pos long, gt array<array<int>>")
    with pytest.raises(TypeError):
        R.roh_mhmm(df, 10, p_accessible=0.9)
