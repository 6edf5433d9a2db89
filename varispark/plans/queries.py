"""Registered queries over the views, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
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
from varispark.plans import text_queries
from varispark.plans.expressions import query
from varispark.plans.views import CALLS_SQL, GRID_SQL, calls_view, grid_view, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(text_queries.QUERIES)
SQL: dict[str, str] = dict(text_queries.SQL)


def r(c: Column | str) -> Column:
    return F.round(c, 9)


def on_calls(name: str, sql: str, pre: str = "") -> Callable:
    """Register f(calls view) with SQL over ``v``."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: f(calls_view(spark, d))
        SQL[name] = f"with recursive {CALLS_SQL}{pre and ', ' + pre} {sql}"
        return f

    return add


def on_grid(name: str, sql: str, pre: str = "") -> Callable:
    """Register f(grid view) with SQL over ``g`` (alleles) and ``c`` (calls x, y)."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: f(grid_view(spark, d))
        if sql:
            SQL[name] = f"with {GRID_SQL}{pre and ', ' + pre} {sql}"
        return f

    return add


# ---------------------------------------------------------------- SQL of the statistics


def an(x: str) -> str:
    return f"({x}0 + {x}1 + {x}2)"


def mpd(x: str) -> str:
    return f"(1.0 - ({x}0 * ({x}0 - 1) + {x}1 * ({x}1 - 1) + {x}2 * ({x}2 - 1))::double / nullif({an(x)} * ({an(x)} - 1), 0))"


def mpdb(x: str, y: str) -> str:
    return f"(1.0 - ({x}0 * {y}0 + {x}1 * {y}1 + {x}2 * {y}2)::double / nullif({an(x)} * {an(y)}, 0))"


def alleles(x: str) -> str:
    return f"(({x}0 > 0)::int + ({x}1 > 0)::int + ({x}2 > 0)::int)"


def fixed(x: str, y: str) -> str:
    return f"({an(x)} > 0 and {an(y)} > 0 and not (({x}0 > 0 and {y}0 > 0) or ({x}1 > 0 and {y}1 > 0) or ({x}2 > 0 and {y}2 > 0)))"


def fr(x: str) -> str:
    return f"({x}1::double / nullif({x}0 + {x}1, 0))"


def hh(x: str) -> str:
    return f"({x}0::double * {x}1 / nullif(({x}0 + {x}1) * ({x}0 + {x}1 - 1), 0))"


def hs(x: str) -> str:
    return f"({hh(x)} / nullif({x}0 + {x}1, 0))"


def f2(x: str, y: str) -> str:
    return f"(({fr(x)} - {fr(y)}) * ({fr(x)} - {fr(y)}) - {hs(x)} - {hs(y)})"


def har(n: str, p: int = 1) -> str:
    return f"(select coalesce(sum(1.0::double / pow(i, {p})), 0) from range(1, greatest(1, ({n})::bigint)) q(i))"


HUDSON = lambda x, y: (f"({mpdb(x, y)} - ({mpd(x)} + {mpd(y)}) / 2)", mpdb(x, y))
PATTERSON = lambda x, y: (f2(x, y), f"({f2(x, y)} + {hh(x)} + {hh(y)})")
F3 = lambda c, a, b: (f"(({fr(c)} - {fr(a)}) * ({fr(c)} - {fr(b)}) - {hs(c)})", f"(2 * {hh(c)})")
DD = lambda a, b, c, d: (f"(({fr(a)} - {fr(b)}) * ({fr(c)} - {fr(d)}))", f"(({fr(a)} + {fr(b)} - 2 * {fr(a)} * {fr(b)}) * ({fr(c)} + {fr(d)} - 2 * {fr(c)} * {fr(d)}))")


def position_windows_sql(size: int, step: int | None = None) -> str:
    """CTE w(w, window_start, window_stop) over the positions of v."""
    step = step or size
    return (
        f"b as (select min(pos) lo, max(pos) hi from v), nw as (select lo, hi, greatest(0, ceil((hi - lo - {size}) / {step}::double))::bigint + 1 n from b where lo < hi), "
        f"w as (select i w, lo + i * {step} window_start, case when i = n - 1 then hi else lo + i * {step} + {size} - 1 end window_stop from nw, range(0, 100000) t(i) where i < n)"
    )


def windowed_sql(columns: str, size: int, step: int | None = None) -> tuple[str, str]:
    return f"select w.w, window_start, window_stop, count(v.vidx) n, {columns} from w left join v on pos between window_start and window_stop group by all", position_windows_sql(size, step)


def index_windows_sql(columns: str, size: int, step: int | None = None, src: str = "v") -> tuple[str, str]:
    step = step or size
    return f"select i w, {columns} from (select t.i, {src}.* from {src}, range(0, 100000) t(i) where t.i * {step} <= (select max(vidx) from {src}) and vidx between t.i * {step} and t.i * {step} + {size} - 1) group by i having count(*) = {size}", ""


TAJIMA = lambda s, pi, n: f"(case when {s} >= 3 then (select ({pi} - {s} / a1) / sqrt(e1 * {s} + e2 * {s} * ({s} - 1)) from (select *, c1 / a1 e1, c2 / (a1 * a1 + a2) e2 from (select *, b1 - 1 / a1 c1, b2 - (nn + 2) / (a1 * nn) + a2 / (a1 * a1) c2 from (select *, (nn + 1) / (3 * (nn - 1)) b1, 2 * (nn * nn + nn + 3) / (9 * nn * (nn - 1)) b2 from (select {n}::double nn, {har(n)} a1, {har(n, 2)} a2))))) end)"

# ---------------------------------------------------------------- allele counts


@on_calls("allele_count_flags", f"select vidx, {alleles('b')}::bigint allelism, (case when b2 > 0 then 2 when b1 > 0 then 1 when b0 > 0 then 0 else -1 end)::bigint max_allele, (b1 > 0 or b2 > 0) is_variant, not (b1 > 0 or b2 > 0) is_non_variant, {alleles('b')} > 1 is_segregating, {alleles('b')} <= 1 is_non_segregating, ({alleles('b')} = 1 and b0 > 0) is_non_segregating_0, b1 = 1 is_singleton, b1 = 2 is_doubleton, {alleles('b')} = 2 is_biallelic, (b0 > 0 and b1 > 0 and b2 = 0) is_biallelic_01, (b0 >= 2 and b1 >= 2 and b2 = 0) is_biallelic_mac2 from v")
def _(df):
    a = F.col("ac_b")
    return df.select("vidx", C.allelism(a).cast("bigint").alias("allelism"), C.max_allele(a).cast("bigint").alias("max_allele"), C.is_variant(a).alias("is_variant"), C.is_non_variant(a).alias("is_non_variant"), C.is_segregating(a).alias("is_segregating"), C.is_non_segregating(a).alias("is_non_segregating"), C.is_non_segregating(a, 0).alias("is_non_segregating_0"), C.is_singleton(a).alias("is_singleton"), C.is_doubleton(a).alias("is_doubleton"), C.is_biallelic(a).alias("is_biallelic"), C.is_biallelic_01(a).alias("is_biallelic_01"), C.is_biallelic_01(a, 2).alias("is_biallelic_mac2"))


@on_calls("allele_count_totals", f"select count(*) n, count(*) filter (where b1 > 0 or b2 > 0) variant, count(*) filter (where {alleles('b')} > 1) segregating, count(*) filter (where {alleles('b')} <= 1) non_segregating, count(*) filter (where b1 = 1) singleton, count(*) filter (where b1 = 2) doubleton from v")
def _(df):
    a = F.col("ac_b")
    return df.agg(F.count("*").alias("n"), F.count_if(C.is_variant(a)).alias("variant"), F.count_if(C.is_segregating(a)).alias("segregating"), F.count_if(C.is_non_segregating(a)).alias("non_segregating"), F.count_if(C.is_singleton(a)).alias("singleton"), F.count_if(C.is_doubleton(a)).alias("doubleton"))


@on_calls("allele_frequencies", f"select vidx, round(b0::double / nullif({an('b')}, 0), 9) f0, round(b1::double / nullif({an('b')}, 0), 9) f1, round(b2::double / nullif({an('b')}, 0), 9) f2 from v")
def _(df):
    f = C.to_frequencies(F.col("ac_b"))
    return df.select("vidx", *[r(f[k]).alias(f"f{k}") for k in range(3)])


@on_calls("allele_count_arithmetic", "select vidx, b0 + c0 s0, b1 + c1 s1, b2 + c2 s2, b0 - c0 d0, b1 - c1 d1, b2 - c2 d2 from v")
def _(df):
    s, d = C.add(F.col("ac_b"), F.col("ac_c")), C.subtract(F.col("ac_b"), F.col("ac_c"))
    return df.select("vidx", *[s[k].alias(f"s{k}") for k in range(3)], *[d[k].alias(f"d{k}") for k in range(3)])


@on_calls("allele_count_map_alleles", "select vidx, a1 m0, 0::bigint m1, a2 m2 from v")
def _(df):
    m = C.map_alleles(F.col("ac"), F.array(F.lit(2), F.lit(0), F.lit(2)), 2)
    return df.select("vidx", *[m[k].alias(f"m{k}") for k in range(3)])


@on_calls("fixed_differences", f"select vidx, {fixed('b', 'd')} fixed from v")
def _(df):
    return df.select("vidx", C.is_fixed_difference(F.col("ac_b"), F.col("ac_d")).alias("fixed"))


@on_calls("private_alleles", "select vidx, " + ", ".join(f"((b{k} > 0)::int + (c{k} > 0)::int + (d{k} > 0)::int) = 1 p{k}" for k in range(3)) + " from v")
def _(df):
    p = C.private_alleles(F.col("ac_b"), F.col("ac_c"), F.col("ac_d"))
    return df.select("vidx", *[p[k].alias(f"p{k}") for k in range(3)])


@on_calls("heterozygosity_expected", f"select vidx, round(1 - (pow(b0::double / nullif({an('b')}, 0), 2) + pow(b1::double / nullif({an('b')}, 0), 2) + pow(b2::double / nullif({an('b')}, 0), 2)), 9) he from v")
def _(df):
    return df.select("vidx", r(C.heterozygosity_expected(F.col("ac_b"), 2)).alias("he"))


@on_calls("create_allele_mapping", "select vidx, (case when vidx % 3 = 0 then 1 when vidx % 3 = 1 then 0 else 2 end)::bigint m0, (case when vidx % 2 = 0 then 3 else -1 end)::bigint m1 from v")
def _(df):
    ref = F.element_at(F.array(F.lit("C"), F.lit("A"), F.lit("G")), (F.col("vidx") % 3 + 1).cast("int"))
    alt = F.array(F.when(F.col("vidx") % 2 == 0, "T").otherwise("X"))
    m = C.create_allele_mapping(ref, alt, F.array(*map(F.lit, "ACGT")))
    return df.select("vidx", m[0].cast("bigint").alias("m0"), m[1].cast("bigint").alias("m1"))


# ---------------------------------------------------------------- spectra

_GRID1 = "k(k) as (select i from range(0, 100000) t(i) where i <= (select max(a1) from v))"


@on_calls("sfs", "select k.k, count(vidx) count from k left join v on a1 = k.k group by k.k", _GRID1)
def _(df):
    return S.sfs(df.withColumn("dac", F.col("ac")[1]), "dac")


@on_calls("sfs_scaled", "select k.k, count(vidx) * k.k count from k left join v on a1 = k.k group by k.k", _GRID1)
def _(df):
    return S.sfs_scaled(df.withColumn("dac", F.col("ac")[1]), "dac")


_TWO = "u as (select vidx, b0, b1, c0, c1, b0 + b1 bn, c0 + c1 cn, least(b0, b1) mb, least(c0, c1) mc from v), n as (select max(bn) n1, max(cn) n2 from u), kb(i) as (select i from range(0, 10000) t(i), n where i <= n1 // 2), kc(j) as (select i from range(0, 10000) t(i), n where i <= n2 // 2), fb(i) as (select i from range(0, 10000) t(i) where i <= (select max(b1) from v)), fc(j) as (select i from range(0, 10000) t(i) where i <= (select max(c1) from v))"
_two = lambda df: df.select("vidx", *[F.slice(f"ac_{x}", 1, 2).alias(x) for x in "bc"]).select("*", F.col("b")[1].alias("db"), F.col("c")[1].alias("dc"))


@on_calls("sfs_folded", "select i k, count(vidx) count from kb left join u on mb = i group by i", _TWO)
def _(df):
    return S.sfs_folded(_two(df), "b")


@on_calls("sfs_folded_scaled", "select i k, round(count(vidx) * i * (n1 - i) / n1::double, 9) count from kb cross join n left join u on mb = i group by i, n1", _TWO)
def _(df):
    return S.sfs_folded_scaled(_two(df), "b").withColumn("count", r("count"))


@on_calls("joint_sfs", "select i, j, count(vidx) count from fb cross join fc left join v on b1 = i and c1 = j group by i, j", _TWO)
def _(df):
    return S.joint_sfs(_two(df), "db", "dc")


@on_calls("joint_sfs_scaled", "select i, j, count(vidx) * i * j count from fb cross join fc left join v on b1 = i and c1 = j group by i, j", _TWO)
def _(df):
    return S.joint_sfs_scaled(_two(df), "db", "dc")


@on_calls("joint_sfs_folded", "select i, j, count(vidx) count from kb cross join kc left join u on mb = i and mc = j group by i, j", _TWO)
def _(df):
    return S.joint_sfs_folded(_two(df), "b", "c")


@on_calls("joint_sfs_folded_scaled", "select i, j, count(vidx) * i * j * (n1 - i) * (n2 - j) count from kb cross join kc cross join n left join u on mb = i and mc = j group by i, j, n1, n2", _TWO)
def _(df):
    return S.joint_sfs_folded_scaled(_two(df), "b", "c")


def _fold_n(df: DataFrame, dac: str, least: int) -> int:
    """Largest count, ``least`` at least, made odd: every bin of an odd n has a mirror, so the fold leaves none out."""
    return max(least, df.agg(F.max(dac)).first()[0] or 0) | 1


_FOLD = "fn as (select greatest(15, max(b1)) | 1 nb, greatest(7, max(b1)) | 1 n1, greatest(7, max(c1)) | 1 n2 from v)"


@on_calls("fold_sfs", "select least(k, nb - k) k, sum(c)::bigint count from (select k, nb, count(vidx) c from (select nb, unnest(range(0, nb + 1)) k from fn) left join v on b1 = k group by k, nb) group by 1", _FOLD)
def _(df):
    two = _two(df)
    n = _fold_n(two, "db", 15)
    return S.fold_sfs(S.sfs(two, "db", n), n)


@on_calls("fold_joint_sfs", "select least(i, n1 - i) i, least(j, n2 - j) j, sum(c)::bigint count from (select i, j, n1, n2, count(vidx) c from (select n1, unnest(range(0, n1 + 1)) i from fn) cross join (select n2, unnest(range(0, n2 + 1)) j from fn) left join v on b1 = i and c1 = j group by all) group by 1, 2", _FOLD)
def _(df):
    two = _two(df)
    n1, n2 = _fold_n(two, "db", 7), _fold_n(two, "dc", 7)
    return S.fold_joint_sfs(S.joint_sfs(two, "db", "dc", n1, n2), n1, n2)


# ---------------------------------------------------------------- windows


@on_calls("windowed_count", "select w.w, window_start, window_stop, count(v.vidx) n from w left join v on pos between window_start and window_stop group by all", position_windows_sql(150, 100))
def _(df):
    return W.windowed_count(df, 150, step=100)


@on_calls("windowed_statistic", *windowed_sql("round(avg(a1), 9) mean, max(a2) top", 130, 50))
def _(df):
    return W.windowed(df, {"mean": r(F.avg(F.col("ac")[1])), "top": F.max(F.col("ac")[2])}, 130, step=50)


@on_calls("moving_mean", *index_windows_sql("round(avg(a1), 9) mean", 30, 20))
def _(df):
    return W.moving_mean(df.withColumn("x", F.col("ac")[1]), "x", 30, step=20).withColumn("mean", r("mean"))


@on_calls("moving_std", *index_windows_sql("round(stddev_pop(a1), 9) std", 50))
def _(df):
    return W.moving_std(df.withColumn("x", F.col("ac")[1]), "x", 50).withColumn("std", r("std"))


@on_calls("moving_midpoint", *index_windows_sql("(arg_min(pos, vidx) + arg_max(pos, vidx)) / 2.0::double midpoint", 25))
def _(df):
    return W.moving_midpoint(df, "pos", 25)


_ACCESS = "acc as (select i * 50 + 1 start, i * 50 + 30 stop from range(0, 100000) t(i) where i * 50 + 1 <= (select max(pos) from v))"


def _accessible(df: DataFrame) -> DataFrame:
    top = df.agg(F.max("pos")).first()[0]
    return df.sparkSession.range((top - 1) // 50 + 1).select((F.col("id") * 50 + 1).alias("start"), (F.col("id") * 50 + 30).alias("stop"))


@on_calls("windowed_diversity_accessible", f"select w.w, window_start, window_stop, n, n_bases, round(s / nullif(n_bases, 0), 9) pi from (select w.w, window_start, window_stop, count(m.vidx) n, coalesce(sum(p), 0) s from w left join m on pos between window_start and window_stop group by all) w join (select w.w, sum(greatest(0, least(window_stop, stop) - greatest(window_start, start) + 1))::bigint n_bases from w cross join acc group by w.w) using (w)", f"{position_windows_sql(120)}, {_ACCESS}, m as (select v.*, {mpd('a')} p from v semi join acc on pos between start and stop)")
def _(df):
    low, high = W.position_bounds(df)
    return V.windowed_diversity(df, 120, start=low, stop=high, accessible=_accessible(df)).withColumn("pi", r("pi"))


@on_calls("mask_inaccessible", "select vidx, pos from v semi join acc on pos between start and stop", _ACCESS)
def _(df):
    return V.mask_inaccessible(df, _accessible(df)).select("vidx", "pos")


@on_calls("equally_accessible_windows", "select i w, min(p) window_start, max(p) window_stop from (select p, (row_number() over (order by p) - 1) // 70 i from (select unnest(range(start, stop + 1)) p from acc)) group by i having count(*) = 70", _ACCESS)
def _(df):
    return W.equally_accessible_windows(_accessible(df), 70)


def _until_last(df: DataFrame, every: int, first: int = 0, least: int = 0) -> DataFrame:
    """id from 0 for each first + id * every up to the last position, and ``least`` ids in any case."""
    top = W.position_bounds(df)[1]
    return df.sparkSession.range(max(least, (top - first) // every + 1))


@on_calls("windowed_given", "select gw.w, window_start, window_stop, count(vidx) n, sum(a1)::bigint s from gw left join v on pos between window_start and window_stop group by all", "gw as (select i w, i * 37 + 1 window_start, i * 37 + 5 + i * 3 window_stop from (select unnest(range(0, greatest(20, (max(pos) - 1) // 37 + 1))) i from v))")
def _(df):
    gw = _until_last(df, 37, 1, least=20).select(F.col("id").alias("w"), (F.col("id") * 37 + 1).alias("window_start"), (F.col("id") * 40 + 5).alias("window_stop"))
    return W.windowed_given(df, {"s": F.sum(F.col("ac")[1])}, gw, bin_size=64, merge={"s": F.sum})


# ---------------------------------------------------------------- diversity


@on_calls("windowed_diversity", f"select w, window_start, window_stop, n, window_stop - window_start + 1 n_bases, round(s / (window_stop - window_start + 1), 9) pi from ({windowed_sql(f'coalesce(sum({mpd("a")}), 0) s', 100)[0]})", position_windows_sql(100))
def _(df):
    return V.windowed_diversity(df, 100).withColumn("pi", r("pi"))


@on_calls("mean_pairwise_difference", f"select vidx, round({mpd('b')}, 9) mpd_within, round({mpdb('b', 'c')}, 9) mpd_between from v")
def _(df):
    return df.select("vidx", r(C.mean_pairwise_difference(F.col("ac_b"))).alias("mpd_within"), r(C.mean_pairwise_difference_between(F.col("ac_b"), F.col("ac_c"))).alias("mpd_between"))


@on_calls("sequence_diversity", f"select round(sum({mpd('a')}) / (max(pos) - min(pos) + 1), 9) pi from v")
def _(df):
    return V.sequence_diversity(df).select(r("pi").alias("pi"))


@on_calls("sequence_divergence", f"select round(sum({mpdb('b', 'c')}) / (max(pos) - min(pos) + 1), 9) dxy from v")
def _(df):
    return V.sequence_divergence(df, "ac_b", "ac_c").select(r("dxy").alias("dxy"))


@on_calls("windowed_divergence", f"select w, window_start, window_stop, n, window_stop - window_start + 1 n_bases, round(s / (window_stop - window_start + 1), 9) dxy from ({windowed_sql(f'coalesce(sum({mpdb("b", "c")}), 0) s', 90, 45)[0]})", position_windows_sql(90, 45))
def _(df):
    return V.windowed_divergence(df, "ac_b", "ac_c", 90, step=45).withColumn("dxy", r("dxy"))


@on_calls("windowed_df", f"select w, window_start, window_stop, n, window_stop - window_start + 1 n_bases, round(s / (window_stop - window_start + 1), 9) df from ({windowed_sql(f'sum(coalesce({fixed("b", "d")}::int, 0))::double s', 80)[0]})", position_windows_sql(80))
def _(df):
    return V.windowed_df(df, "ac_b", "ac_d", 80).withColumn("df", r("df"))


@on_calls("watterson_theta", f"select round(s / a1 / bases, 9) theta from (select s, {har('m')} a1, bases from (select count(*) filter (where {alleles('b')} > 1)::double s, max({an('b')}) m, max(pos) - min(pos) + 1 bases from v))")
def _(df):
    return V.watterson_theta(df, "ac_b").select(r("theta").alias("theta"))


@on_calls("windowed_watterson_theta", f"select w, window_start, window_stop, n, window_stop - window_start + 1 n_bases, round(s / (window_stop - window_start + 1) / (select {har('m')} from (select max({an('b')}) m from v)), 9) theta from ({windowed_sql(f'count(*) filter (where {alleles("b")} > 1)::double s', 100)[0]})", position_windows_sql(100))
def _(df):
    return V.windowed_watterson_theta(df, 100, "ac_b").withColumn("theta", r("theta"))


_TP = f"count(*) filter (where {alleles('b')} > 1) s, coalesce(sum({mpd('b')}), 0) pi, max({an('b')}) m"


@on_calls("tajima_d", f"select round({TAJIMA('s', 'pi', 'm')}, 9) d from (select {_TP} from v)")
def _(df):
    return V.tajima_d(df, "ac_b").select(r("d").alias("d"))


@on_calls("windowed_tajima_d", f"select w, window_start, window_stop, n, round({TAJIMA('s', 'pi', 'gm')}, 9) d from (select *, (select max({an('b')}) from v) gm from ({windowed_sql(_TP, 100)[0]}))", position_windows_sql(100))
def _(df):
    return V.windowed_tajima_d(df, 100, "ac_b").withColumn("d", r("d"))


@on_calls("moving_tajima_d", f"select w, round({TAJIMA('s', 'pi', 'm')}, 9) d from ({index_windows_sql(_TP, 40)[0]})")
def _(df):
    return V.moving_tajima_d(df, 40, "ac_b").withColumn("d", r("d"))


@on_calls("moving_delta_tajima_d", "select w, round((d1 - d2 - avg(d1 - d2) over ()) / stddev_pop(d1 - d2) over (), 7) delta from t1 join t2 using (w)", f"t1 as (select w, {TAJIMA('s', 'pi', 'm')} d1 from ({index_windows_sql(_TP, 40)[0]})), t2 as (select w, {TAJIMA('s', 'pi', 'm')} d2 from ({index_windows_sql(_TP.replace('b0', 'c0').replace('b1', 'c1').replace('b2', 'c2'), 40)[0]}))")
def _(df):
    return V.moving_delta_tajima_d(df, "ac_b", "ac_c", 40).withColumn("delta", F.round("delta", 7))


# ---------------------------------------------------------------- differentiation


def _average_sql(parts: tuple[str, str], blen: int, z: bool = False) -> tuple[str, str]:
    num, den = parts
    pre = f"q as (select vidx, {num} num, {den} den from v), bl as ({index_windows_sql('sum(num) num, sum(den) den', blen, src='q')[0]}), j as (select ((select sum(num) from bl) - coalesce(num, 0)) / nullif((select sum(den) from bl) - coalesce(den, 0), 0) vj from bl), m as (select avg(vj) m, count(*) n from j)"
    se = "sqrt((n - 1) / n::double * (select sum((vj - m) * (vj - m)) from j))"
    return f"select round(estimate, 9) estimate, round(se, 9) se, n_blocks{', round(estimate / se, 6) z' if z else ''} from (select (select sum(num) / sum(den) from q) estimate, {se} se, n n_blocks from m)", pre


_FST = {"hudson": (HUDSON, C.hudson_fst, D.windowed_hudson_fst, D.moving_hudson_fst, D.average_hudson_fst), "patterson": (PATTERSON, C.patterson_fst, D.windowed_patterson_fst, D.moving_patterson_fst, D.average_patterson_fst)}

for _name, (_sql, _parts, _win, _mov, _avg) in _FST.items():
    _n, _d = _sql("b", "c")

    @on_calls(f"{_name}_fst", f"select vidx, round({_n}, 9) num, round({_d}, 9) den from v")
    def _(df, f=_parts):
        n, d = f(F.col("ac_b"), F.col("ac_c"))
        return df.select("vidx", r(n).alias("num"), r(d).alias("den"))

    @on_calls(f"windowed_{_name}_fst", *windowed_sql(f"round(sum({_n}) / nullif(sum({_d}), 0), 9) fst", 100))
    def _(df, f=_win):
        return f(df, "ac_b", "ac_c", 100).withColumn("fst", r("fst"))

    @on_calls(f"moving_{_name}_fst", *index_windows_sql(f"round(sum({_n}) / nullif(sum({_d}), 0), 9) fst", 40, 20))
    def _(df, f=_mov):
        return f(df, "ac_b", "ac_c", 40, step=20).withColumn("fst", r("fst"))

    @on_calls(f"average_{_name}_fst", *_average_sql((_n, _d), 20))
    def _(df, f=_avg):
        return f(df, "ac_b", "ac_c", 20).select(r("estimate").alias("estimate"), r("se").alias("se"), "n_blocks")


@on_calls("patterson_f2", f"select vidx, round({f2('b', 'c')}, 9) f2 from v")
def _(df):
    return df.select("vidx", r(C.patterson_f2(F.col("ac_b"), F.col("ac_c"))).alias("f2"))


@on_calls("patterson_f3", "select vidx, round({}, 9) t, round({}, 9) b from v".format(*F3("b", "c", "d")))
def _(df):
    t, b = C.patterson_f3(F.col("ac_b"), F.col("ac_c"), F.col("ac_d"))
    return df.select("vidx", r(t).alias("t"), r(b).alias("b"))


@on_calls("patterson_d", "select vidx, round({}, 9) num, round({}, 9) den from v".format(*DD("b", "c", "d", "e")))
def _(df):
    n, d = C.patterson_d(*[F.col(f"ac_{x}") for x in "bcde"])
    return df.select("vidx", r(n).alias("num"), r(d).alias("den"))


@on_calls("moving_patterson_f3", *index_windows_sql("round(sum({}) / sum({}), 9) f3".format(*F3("b", "c", "d")), 50))
def _(df):
    return D.moving_patterson_f3(df, "ac_b", "ac_c", "ac_d", 50).withColumn("f3", r("f3"))


@on_calls("moving_patterson_d", *index_windows_sql("round(sum({}) / sum({}), 9) d".format(*DD("b", "c", "d", "e")), 50))
def _(df):
    return D.moving_patterson_d(df, "ac_b", "ac_c", "ac_d", "ac_e", 50).withColumn("d", r("d"))


@on_calls("average_patterson_f3", *_average_sql(F3("b", "c", "d"), 20, True))
def _(df):
    return D.average_patterson_f3(df, "ac_b", "ac_c", "ac_d", 20).select(r("estimate").alias("estimate"), r("se").alias("se"), "n_blocks", F.round("z", 6).alias("z"))


@on_calls("average_patterson_d", *_average_sql(DD("b", "c", "d", "e"), 20, True))
def _(df):
    return D.average_patterson_d(df, "ac_b", "ac_c", "ac_d", "ac_e", 20).select(r("estimate").alias("estimate"), r("se").alias("se"), "n_blocks", F.round("z", 6).alias("z"))


def _pbs_sql() -> tuple[str, str]:
    cols = ", ".join(f"-ln(1 - least(greatest(sum({n}) / sum({d}), 0), 0.99999)) t{i}" for i, (x, y) in enumerate((("b", "c"), ("b", "d"), ("c", "d"))) for n, d in [HUDSON(x, y)])
    return f"select w, round((t0 + t1 - t2) / 2 / (1 + (t0 + t1 + t2) / 2), 9) pbs from ({index_windows_sql(cols, 40)[0]})", ""


@on_calls("pbs", *_pbs_sql())
def _(df):
    return D.pbs(df, "ac_b", "ac_c", "ac_d", 40).withColumn("pbs", r("pbs"))


@on_calls("jackknife_mean", "select round(avg(vj), 9) mean, round(sqrt((max(n) - 1) / max(n)::double * sum((vj - m) * (vj - m))), 9) se, max(n) n from (select *, avg(vj) over () m from (select (sum(a1) over () - a1)::double / (count(*) over () - 1) vj, count(*) over () n from v))")
def _(df):
    return D.jackknife(df.select(F.col("ac")[1].alias("x")), "x").select(r("mean").alias("mean"), r("se").alias("se"), "n")


# ---------------------------------------------------------------- tables and indexes


@on_calls("table_query", "select vidx, a0, a1 from v where (a1 > 8 and a0 < 12) or not a2 <> 5")
def _(df):
    return query(df.select("vidx", F.col("ac")[0].alias("a0"), F.col("ac")[1].alias("a1"), F.col("ac")[2].alias("a2")), "((a1 > 8) & (a0 < 12)) | ~(a2 != 5)").select("vidx", "a0", "a1")


@on_calls("index_intersect", "select vidx, pos from v semi join (select unnest(range(0, max(pos) // 7 + 1)) * 7 pos from v) using (pos)")
def _(df):
    return I.intersect(df, _until_last(df, 7).select((F.col("id") * 7).alias("pos")), "pos").select("vidx", "pos")


@on_calls("index_locate_keys", "select vidx, pos in (select unnest(range(0, max(pos) // 7 + 1)) * 7 from v) found from v")
def _(df):
    return I.locate_keys(df, _until_last(df, 7).select((F.col("id") * 7).alias("pos")), "pos", strict=False).select("vidx", "found")


@on_calls("index_locate_range", "select vidx, pos from v where pos between 50 and 77")
def _(df):
    return I.locate_range(df, "pos", 50, 77).select("vidx", "pos")


_RANGES = "rg as (select i * 61 + 3 start, i * 61 + 3 + i % 9 stop from (select unnest(range(0, (max(pos) - 3) // 61 + 1)) i from v))"
_ranges = lambda df: _until_last(df, 61, 3).select((F.col("id") * 61 + 3).alias("start"), (F.col("id") * 61 + 3 + F.col("id") % 9).alias("stop"))


@on_calls("index_intersect_ranges", "select vidx, pos from v semi join rg on pos between start and stop", _RANGES)
def _(df):
    return I.intersect_ranges(df, _ranges(df), "pos", bin_size=50).select("vidx", "pos")


@on_calls("index_ranges_with_rows", "select start, stop from rg semi join v on pos between start and stop", _RANGES)
def _(df):
    return I.locate_intersection_ranges(df, _ranges(df), "pos", bin_size=50)[1].select("start", "stop")


@on_calls("feature_mask", "select min(p) start, max(p) stop from (select p, p - row_number() over (order by p) grp from (select distinct unnest(range(start, stop + 1)) p from ft)) group by grp", "ft as (select i * 13 + 1 start, i * 13 + 1 + (i * 7) % 20 stop from (select unnest(range(0, greatest(90, (max(pos) - 1) // 13 + 1))) i from v))")
def _(df):
    ft = _until_last(df, 13, 1, least=90).select((F.col("id") * 13 + 1).alias("start"), (F.col("id") * 13 + 1 + (F.col("id") * 7) % 20).alias("end"))
    return I.interval_union(ft)


# ---------------------------------------------------------------- genotype grid

_FLAGS = {
    "called": ("(x >= 0 and y >= 0)", G.is_called),
    "missing": ("(x < 0 or y < 0)", G.is_missing),
    "hom": ("(x >= 0 and x = y)", G.is_hom),
    "hom_ref": ("(x = 0 and y = 0)", G.is_hom_ref),
    "hom_alt": ("(x > 0 and x = y)", G.is_hom_alt),
    "het": ("(x >= 0 and y >= 0 and x <> y)", G.is_het),
    "het_1": ("(x >= 0 and y >= 0 and x <> y and (x = 1 or y = 1))", lambda g: G.is_het(g, 1)),
    "call_01": ("(x = 0 and y = 1)", lambda g: G.is_call(g, [0, 1])),
}


def _flag_columns(agg: Callable) -> list[Column]:
    return [agg(f(F.col("gt"))).alias(n) for n, (_, f) in _FLAGS.items()]


_FLAG_SQL = ", ".join(f"count(*) filter (where {s}) {n}" for n, (s, _) in _FLAGS.items())


@on_grid("genotype_counts_per_variant", f"select vidx, {_FLAG_SQL} from c group by vidx")
def _(df):
    return df.select("vidx", *_flag_columns(G.count_true))


@on_grid("genotype_counts_per_sample", f"select s::int sidx, {_FLAG_SQL} from c group by s")
def _(df):
    one = F.arrays_zip(*_flag_columns(lambda x: x))
    return df.select(F.posexplode(one).alias("sidx", "f")).groupBy("sidx").agg(*[F.count_if(F.col("f")[n]).alias(n) for n in _FLAGS])


@on_grid("genotype_counts_total", f"select {_FLAG_SQL}, count(*) n_calls from c")
def _(df):
    return df.agg(*[F.sum(G.count_true(f(F.col("gt")))).alias(n) for n, (_, f) in _FLAGS.items()], F.sum(F.size("gt")).alias("n_calls"))


def _per_call(df: DataFrame, **columns: Column) -> DataFrame:
    z = F.arrays_zip(*[c.alias(k) for k, c in columns.items()])
    return df.select("vidx", F.posexplode(z).alias("sidx", "z")).select("vidx", "sidx", *[F.col("z")[k].alias(k) for k in columns])


@on_grid("genotype_recoded", "select vidx, s::int sidx, ((x = 0)::int + (y = 0)::int)::int n_ref, ((x > 0)::int + (y > 0)::int)::int n_alt, case when x < 0 or y < 0 then -1 else (x > 0)::int + (y > 0)::int end::int n_alt_fill, case when x < 0 then '.' else x::varchar end || '/' || case when y < 0 then '.' else y::varchar end gt, ((((x + 1) * 16 + (y + 1)) - 17 + 256) % 256)::int packed from c")
def _(df):
    g = F.col("gt")
    return _per_call(df, n_ref=G.to_n_ref(g), n_alt=G.to_n_alt(g), n_alt_fill=G.to_n_alt(g, -1), gt=G.to_gt(g), packed=F.transform(G.pack_diploid(g), lambda x: x.cast("int")))


@on_grid("genotype_pack_round_trip", "select vidx, s::int sidx, x::int x, y::int y from c")
def _(df):
    g = G.unpack_diploid(G.pack_diploid(F.col("gt")))
    return _per_call(df, x=F.transform(g, lambda c: c[0].cast("int")), y=F.transform(g, lambda c: c[1].cast("int")))


@on_grid("genotype_masked", "select vidx, count(*) filter (where (s + vidx) % 3 <> 0 and x >= 0 and y >= 0) called, count(*) filter (where (s + vidx) % 3 = 0 or x < 0 or y < 0) missing, count(*) filter (where (s + vidx) % 3 <> 0 and x >= 0 and y >= 0 and x <> y) het from c group by vidx")
def _(df):
    m = F.transform(F.col("gt"), lambda g, i: (i + F.col("vidx")) % 3 == 0)
    g = F.col("gt")
    return df.select("vidx", G.count_true(G.is_called(g, m)).alias("called"), G.count_true(G.is_missing(g, m)).alias("missing"), G.count_true(G.is_het(g, None, m)).alias("het"))


@on_grid("count_alleles", "select vidx, count(*) filter (where a = 0) a0, count(*) filter (where a = 1) a1, count(*) filter (where a = 0 and s in (1, 3, 5)) p0, count(*) filter (where a = 1 and s in (1, 3, 5)) p1 from g group by vidx")
def _(df):
    x = T.count_alleles(df, 1).select("vidx", F.col("ac")[0].alias("a0"), F.col("ac")[1].alias("a1"))
    y = T.count_alleles_subpops(df, {"p": [1, 3, 5]}, 1).select("vidx", F.col("ac_p")[0].alias("p0"), F.col("ac_p")[1].alias("p1"))
    return x.join(y, "vidx")


@on_grid("genotype_long", "select vidx, s::int sidx, k::int pidx, a::int allele from g")
def _(df):
    return T.to_long(df).withColumn("allele", F.col("allele").cast("int"))


@on_grid("genotype_take_compress", "select vidx, (case s when 7 then 0 when 2 then 1 else 2 end)::int slot, x::int x, y::int y from c where s in (7, 2, 11) and vidx % 2 = 0")
def _(df):
    d = T.take_samples(T.compress_variants(df, F.col("vidx") % 2 == 0), [7, 2, 11])
    g = F.col("gt")
    return _per_call(d, x=F.transform(g, lambda c: c[0].cast("int")), y=F.transform(g, lambda c: c[1].cast("int"))).withColumnRenamed("sidx", "slot")


@on_grid("haplotype_map_alleles", "select vidx, hidx::int hidx, (case a when 0 then 1 when 1 then 0 else -1 end)::int allele from g")
def _(df):
    m = G.map_alleles(F.col("h"), F.array(F.lit(1), F.lit(0)))
    return df.select("vidx", F.posexplode(m).alias("hidx", "allele")).withColumn("allele", F.col("allele").cast("int"))


@on_grid("haplotype_counts", "select vidx, count(*) filter (where a >= 0) called, count(*) filter (where a < 0) missing, count(*) filter (where a = 0) ref, count(*) filter (where a > 0) alt from g group by vidx")
def _(df):
    h = F.col("h")
    return df.select("vidx", *[G.count_true(f(h)).alias(n) for n, f in (("called", G.h_is_called), ("missing", G.h_is_missing), ("ref", G.h_is_ref), ("alt", G.h_is_alt))])


@on_grid("genotype_sparse", "select vidx, hidx::int hidx, a::int allele from g where a <> 0")
def _(df):
    return T.to_sparse(df).withColumn("allele", F.col("allele").cast("int"))


@on_grid("call_allele_counts", "select vidx, s::int sidx, not (x < 0 and y < 0) called, ((x = 0 or y = 0)::int + (x = 1 or y = 1)::int) = 1 hom, ((x = 0 or y = 0)::int + (x = 1 or y = 1)::int) > 1 het, (case when x = 1 or y = 1 then 1 when x = 0 or y = 0 then 0 else -1 end)::int max_allele, ((x = 0)::int + (y = 0)::int)::varchar || ':' || ((x = 1)::int + (y = 1)::int)::varchar text from c")
def _(df):
    c = G.to_allele_counts(F.col("gt"), 1)
    return _per_call(df.withColumn("gac", c), called=G.gac_is_called(F.col("gac")), hom=G.gac_is_hom(F.col("gac")), het=G.gac_is_het(F.col("gac")), max_allele=G.gac_max_allele(F.col("gac")), text=G.gac_to_gt(F.col("gac")))


@on_grid("heterozygosity_observed", "select vidx, round(count(*) filter (where x >= 0 and y >= 0 and x <> y)::double / nullif(count(*) filter (where x >= 0 and y >= 0), 0), 9) ho from c group by vidx")
def _(df):
    return T.heterozygosity_observed(df).withColumn("ho", r("ho"))


@on_grid("inbreeding_coefficient", "select vidx, round(case when he > 0 then 1 - ho / he end, 9) f from (select vidx, count(*) filter (where x >= 0 and y >= 0 and x <> y)::double / nullif(count(*) filter (where x >= 0 and y >= 0), 0) ho from c group by vidx) join (select vidx, 1 - pow(count(*) filter (where a = 0)::double / nullif(count(*) filter (where a >= 0), 0), 2) - pow(count(*) filter (where a = 1)::double / nullif(count(*) filter (where a >= 0), 0), 2) he from g group by vidx) using (vidx)")
def _(df):
    return T.inbreeding_coefficient(df, 1).withColumn("f", r("f"))


_POPS = [list(range(0, 6)), list(range(6, 13)), list(range(13, 20))]
_WC = (
    "pp as (select vidx, case when s < 6 then 0 when s < 13 then 1 else 2 end p, t.al, count(*) filter (where a = t.al)::double ac, count(*) filter (where a >= 0)::double an, floor(count(*) filter (where a >= 0) / 2)::double n from g, range(2) t(al) group by all), "
    "tt as (select vidx, al, sum(n) nt, sum(n) / 3 nb, (sum(n) - sum(n * n) / nullif(sum(n), 0)) / 2 nc, sum(ac) / nullif(sum(an), 0) pb from pp group by all), "
    "ss as (select vidx, al, sum(n * pow(ac / nullif(an, 0) - pb, 2)) / nullif(any_value(nb) * 2, 0) s2, count(*) filter (where an > 0) np from pp join tt using (vidx, al) group by all), "
    "he as (select vidx, t.al, count(*) filter (where x >= 0 and y >= 0 and x <> y and (x = t.al or y = t.al))::double h from c, range(2) t(al) group by all), "
    "wc as (select vidx, al, nb / nullif(nc, 0) * (s2 - 1 / nullif(nb - 1, 0) * (pb * (1 - pb) - 2 * s2 / 3 - h / nt / 4)) a, nb / nullif(nb - 1, 0) * (pb * (1 - pb) - 2 * s2 / 3 - (2 * nb - 1) * (h / nt) / (4 * nb)) b, h / nt / 2 c from tt join ss using (vidx, al) join he using (vidx, al))"
)


@on_grid("weir_cockerham_fst", "select vidx, round(sum(a), 9) wc_a, round(sum(b), 9) wc_b, round(sum(c), 9) wc_c from wc group by vidx", _WC)
def _(df):
    return D.weir_cockerham(df, _POPS, 1).select("vidx", r("wc_a").alias("wc_a"), r("wc_b").alias("wc_b"), r("wc_c").alias("wc_c"))


@on_grid("moving_weir_cockerham_fst", "select vidx // 25 w, round(sum(a) / sum(a + b + c), 9) fst from wc where vidx < (select (max(vidx) + 1) // 25 * 25 from wc) group by 1", _WC)
def _(df):
    return D.moving_weir_cockerham_fst(df, _POPS, 25, 1).withColumn("fst", r("fst"))


# ---------------------------------------------------------------- pairs and haplotypes

_GN = "n as (select vidx, pos, s, case when x < 0 or y < 0 then -1 else (x > 0)::int + (y > 0)::int end v from c)"
_ON = "filter (where p.v >= 0 and q.v >= 0)"
_R = f"(count(*) {_ON} * sum(p.v * q.v) {_ON} - sum(p.v) {_ON} * sum(q.v) {_ON})::double / nullif(sqrt((count(*) {_ON} * sum(p.v * p.v) {_ON} - sum(p.v) {_ON} * sum(p.v) {_ON})::double * (count(*) {_ON} * sum(q.v * q.v) {_ON} - sum(q.v) {_ON} * sum(q.v) {_ON})), 0)"
_contig_size = lambda df: W.position_bounds(df)[1] + 9  # a variant stands at the first of its ten bases
_gn = lambda df, fill=-1: df.select("vidx", "pos", G.to_n_alt(F.col("gt"), fill).alias("gn"))


@on_grid("rogers_huff_r", f"select p.vidx i, q.vidx j, round({_R}, 7) r from n p join n q on p.s = q.s and p.vidx < q.vidx group by 1, 2", _GN)
def _(df):
    return P.rogers_huff_r(_gn(df), digits=7)


@on_grid("windowed_r_squared", f"select w, quantile_cont(r * r, 0.5) p50 from (select p.vidx // 20 w, p.vidx i, q.vidx j, {_R} r from n p join n q on p.s = q.s and p.vidx < q.vidx and p.vidx // 20 = q.vidx // 20 group by 1, 2, 3) group by w", _GN)
def _(df):
    got = P.windowed_r_squared(_gn(df), 200, start=1, stop=_contig_size(df))
    return got.select("w", F.col("p50"))


SQL["windowed_r_squared"] = SQL["windowed_r_squared"].replace("select w, quantile_cont(r * r, 0.5) p50", "select w, round(quantile_cont(r * r, 0.5), 7) p50")
_old = QUERIES["windowed_r_squared"]
QUERIES["windowed_r_squared"] = lambda spark, d: _old(spark, d).select("w", F.round("p50", 7).alias("p50"))


@on_grid("pairwise_distance", "select p.s::int i, q.s::int j, round(sqrt(sum((p.m - q.m) * (p.m - q.m))), 7) distance from (select vidx, s, (x > 0)::int + (y > 0)::int m from c) p join (select vidx, s, (x > 0)::int + (y > 0)::int m from c) q on p.vidx = q.vidx and p.s < q.s group by 1, 2")
def _(df):
    return P.pairwise_distance(_gn(df, 0)).withColumn("distance", F.round("distance", 7))


@on_grid("pairwise_dxy", "select p.s::int i, q.s::int j, round(sum(1 - (p.r * q.r + p.t * q.t)::double / nullif((p.r + p.t) * (q.r + q.t), 0)) / (select max(pos) from c), 9) dxy from m p join m q on p.vidx = q.vidx and p.s < q.s group by 1, 2", "m as (select vidx, s, (x = 0)::int + (y = 0)::int r, (x = 1)::int + (y = 1)::int t from c)")
def _(df):
    return P.pairwise_dxy(df.withColumn("gac", G.to_allele_counts(F.col("gt"), 1)), start=1, stop=W.position_bounds(df)[1]).withColumn("dxy", r("dxy"))


_SEQ = "sq as (select vidx // 3 w, hidx, string_agg(a::varchar, ',' order by vidx) q from g where vidx < (select (max(vidx) + 1) // 3 * 3 from g) group by all), cn as (select w, q, count(*) n from sq group by all), rk as (select w, n / 40.0::double f, row_number() over (partition by w order by n desc) r from cn)"


@on_grid("moving_garud_h", "select w, round(sum(f * f), 9) h1, round(pow(sum(f) filter (where r <= 2), 2) + coalesce(sum(f * f) filter (where r > 2), 0), 9) h12, round(pow(sum(f) filter (where r <= 3), 2) + coalesce(sum(f * f) filter (where r > 3), 0), 9) h123, round(coalesce(sum(f * f) filter (where r > 1), 0) / sum(f * f), 9) h2_h1, round((1 - sum(f * f)) * 40 / 39, 9) diversity from rk group by w", _SEQ)
def _(df):
    return H.moving_garud_h(df, 3).select("w", *[r(c).alias(c) for c in ("h1", "h12", "h123", "h2_h1", "diversity")])


@on_grid("haplotype_distinct", "select n count, round(n / 40.0::double, 9) frequency, count(*) groups from (select q, count(*) n from (select hidx, string_agg(a::varchar, ',' order by vidx) q from g group by hidx) group by q) group by n")
def _(df):
    return H.distinct(df).groupBy("count", r("frequency").alias("frequency")).agg(F.count("*").alias("groups"))


@on_grid("ehh_decay", "select d, round(count(*) filter (where br > d) / count(*)::double, 9) ehh from (select i, j, coalesce(min(vidx) filter (where u <> w), (select max(vidx) + 1 from g)) br from (select p.vidx, p.hidx i, q.hidx j, p.a u, q.a w from g p join g q on p.vidx = q.vidx and p.hidx < q.hidx) group by all), (select distinct vidx d from g) group by d")
def _(df):
    return H.ehh_decay(df).select("d", r("ehh").alias("ehh"))


@on_grid("shared_suffix_lengths", "select vidx, hi::int i, hj::int j, vidx - coalesce(max(case when u >= 0 and w >= 0 and u <> w then vidx end) over (partition by hi, hj order by vidx), -1) ssl from (select p.vidx, p.hidx hi, q.hidx hj, p.a u, q.a w from g p join g q on p.vidx = q.vidx and p.hidx < q.hidx)")
def _(df):
    return H.shared_suffix_lengths(df, by_class=False).select("vidx", "i", "j", "ssl")


_NSL = "pr as (select p.vidx, p.hidx hi, q.hidx hj, p.a u, q.a w from g p join g q on p.vidx = q.vidx and p.hidx < q.hidx), ss as (select *, vidx - coalesce(max(case when u >= 0 and w >= 0 and u <> w then vidx end) over (partition by hi, hj order by vidx), -1) f, coalesce(min(case when u >= 0 and w >= 0 and u <> w then vidx end) over (partition by hi, hj order by vidx desc), (select max(vidx) + 1 from g)) - vidx b from pr)"


@on_grid("nsl", "select v.vidx, round(ln(b1 / b0), 9) nsl from (select distinct vidx from g) v left join (select vidx, avg(f) filter (where u = 0 and w = 0) + avg(b) filter (where u = 0 and w = 0) b0, avg(f) filter (where u = 1 and w = 1) + avg(b) filter (where u = 1 and w = 1) b1 from ss group by vidx) s on s.vidx = v.vidx", _NSL)
def _(df):
    return H.nsl(df).withColumn("nsl", r("nsl"))


@on_grid("garud_h", "select round(sum(f * f), 9) h1, round(pow(sum(f) filter (where r <= 2), 2) + coalesce(sum(f * f) filter (where r > 2), 0), 9) h12, round(pow(sum(f) filter (where r <= 3), 2) + coalesce(sum(f * f) filter (where r > 3), 0), 9) h123, round(coalesce(sum(f * f) filter (where r > 1), 0) / sum(f * f), 9) h2_h1, round((1 - sum(f * f)) * 40 / 39, 9) diversity from (select n / 40.0::double f, row_number() over (order by n desc) r from (select q, count(*) n from (select string_agg(a::varchar, ',' order by vidx) q from g group by hidx) group by q))")
def _(df):
    return H.garud_h(df).select(*[r(c).alias(c) for c in ("h1", "h12", "h123", "h2_h1", "diversity")])


@on_grid("moving_hfs_rank", "select w, unnest(range(t - n, t)) slot, case when n > 1 then r else 0 end::int rank from (select w, n, row_number() over (partition by w order by n desc, q) r, sum(n) over (partition by w order by n desc, q rows unbounded preceding)::bigint t from (select w, q, count(*) n from (select vidx // 2 w, hidx, list(a order by vidx) q from g where vidx < (select (max(vidx) + 1) // 2 * 2 from g) group by all) group by w, q))")
def _(df):
    return H.moving_hfs_rank(df, 2)


_PAINT = "f as (select p.hidx i, q.hidx j, coalesce(min(p.vidx) filter (where greatest(p.a, 0) <> greatest(q.a, 0)), (select max(vidx) + 1 from g)) brk from g p join g q on p.vidx = q.vidx and p.hidx <> q.hidx group by 1, 2)"


@on_grid("voight_painting_shared", "select v.vidx, h.hidx::int hidx, exists (select 1 from f where f.i = h.hidx and f.brk > v.vidx) shared from (select distinct vidx from g) v, range(40) h(hidx)", _PAINT)
def _(df):
    d = df.withColumn("h", F.transform("h", lambda a: F.greatest(a.cast("int"), F.lit(0))))
    return H.voight_painting(d).select("vidx", "hidx", (F.col("colour") > 0).alias("shared"))


@on_grid("neighbour_shared_prefix_lengths", "select hidx::int hidx, coalesce(min(vidx) filter (where a <> b), (select max(vidx) + 1 from g)) length from (select p.vidx, p.hidx, p.a, q.a b from g p join g q on p.vidx = q.vidx and q.hidx = p.hidx + 1) group by hidx")
def _(df):
    return H.neighbour_shared_prefix_lengths(df, ordered=False).select("hidx", "length")


@on_calls("standardize", "select vidx, round((a1 - avg(a1) over ()) / stddev_pop(a1) over (), 7) z from v")
def _(df):
    return H.standardize(df.select("vidx", F.col("ac")[1].alias("x")), "x").select("vidx", F.round("z", 7).alias("z"))


@on_calls("standardize_by_allele_count", "select vidx, round((x - avg(x) filter (where a1 between 5 and 15) over (partition by k)) / nullif(stddev_pop(x) filter (where a1 between 5 and 15) over (partition by k), 0), 7) z from (select *, a0::double x, (a1 >= 8)::int + (a1 >= 11)::int k from v)")
def _(df):
    d = df.select("vidx", F.col("ac")[0].cast("double").alias("x"), F.col("ac")[1].alias("n"))
    return H.standardize_by_allele_count(d, "x", "n", bins=[5, 8, 11, 15]).select("vidx", F.round("z", 7).alias("z"))


@on_grid("scale_patterson", "select vidx, s::int sidx, round((v - m) / sqrt(nullif(m / 2 * (1 - m / 2), 0)), 7) z from (select *, avg(v) over (partition by vidx) m from (select vidx, s, (x > 0)::int + (y > 0)::int v from c)) where m > 0 and m < 2")
def _(df):
    z = P.get_scaler("patterson").fit_transform(_gn(df, 0)).where("gn is not null")
    return z.select("vidx", F.posexplode("gn").alias("sidx", "z")).withColumn("z", F.round("z", 7))


_WC_V = _WC + ", v as (select vidx, any_value(vidx * 10 + 1) pos, sum(a) wa, sum(a + b + c) wd from wc group by vidx)"


@on_grid("windowed_weir_cockerham_fst", windowed_sql("round(sum(wa) / nullif(sum(wd), 0), 9) fst", 500)[0], f"{_WC_V}, {position_windows_sql(500)}")
def _(df):
    return D.windowed_weir_cockerham_fst(df, _POPS, 500, 1).withColumn("fst", r("fst"))


@on_grid("average_weir_cockerham_fst", _average_sql(("wa", "wd"), 20)[0], f"{_WC_V}, {_average_sql(('wa', 'wd'), 20)[1]}")
def _(df):
    return D.average_weir_cockerham_fst(df, _POPS, 20, 1).select(r("estimate").alias("estimate"), r("se").alias("se"), "n_blocks")


for _metric, _total in {"cityblock": "sum(abs(p.m - q.m))::double", "chebyshev": "max(abs(p.m - q.m))::double", "hamming": "avg((p.m <> q.m)::int)"}.items():

    @on_grid(f"pairwise_{_metric}", f"select p.s::int i, q.s::int j, round({_total}, 7) distance from m p join m q on p.vidx = q.vidx and p.s < q.s group by 1, 2", "m as (select vidx, s, (x > 0)::int + (y > 0)::int m from c)")
    def _(df, metric=_metric):
        return P.pairwise_distance(_gn(df, 0), metric=metric).withColumn("distance", F.round("distance", 7))


# ---------------------------------------------------------------- pedigree and runs


@on_grid("mendel_errors", "select p.vidx, (q.s - 2)::int progeny, (case when p.x < 0 or p.y < 0 or m.x < 0 or m.y < 0 then 0 when not (p.x = m.x or p.x = m.y or p.y = m.x or p.y = m.y) and ((least(q.x, q.y) = least(p.x, p.y) and greatest(q.x, q.y) = greatest(p.x, p.y)) or (least(q.x, q.y) = least(m.x, m.y) and greatest(q.x, q.y) = greatest(m.x, m.y))) then 1 else greatest(0, (q.x = 0)::int + (q.y = 0)::int - (p.x = 0 or p.y = 0)::int - (m.x = 0 or m.y = 0)::int) + greatest(0, (q.x = 1)::int + (q.y = 1)::int - (p.x = 1 or p.y = 1)::int - (m.x = 1 or m.y = 1)::int) end)::int errors from c p join c m on m.vidx = p.vidx and m.s = 1 join c q on q.vidx = p.vidx and q.s >= 2 where p.s = 0")
def _(df):
    return df.select("vidx", F.posexplode(M.mendel_errors(F.col("gt"))).alias("progeny", "errors"))


@on_grid("paint_transmission", "select q.vidx, (q.hidx - 2)::int gamete, (case when q.a < 0 then 7 when c.x < 0 or c.y < 0 then 6 when q.a <> c.x and q.a <> c.y then 5 when c.x = c.y and c.x > 0 then 4 when c.x = c.y then 3 when q.a = c.y then 2 else 1 end)::int state from g q join c on c.vidx = q.vidx and c.s = 0 where q.hidx >= 2")
def _(df):
    return df.select("vidx", F.posexplode(M.paint_transmission(F.col("gt")[0], F.slice("h", 3, 38))).alias("gamete", "state"))


_EV = "ev as (select user_id part, event_id idx, event_type st from events where event_type <> 'view'), lg as (select *, lag(idx) over (partition by part order by idx) prev, lead(idx) over (partition by part order by idx) nxt, case when lag(st) over (partition by part order by idx) = st then 0 else 1 end nw from ev), rn as (select *, sum(nw) over (partition by part order by idx) run from lg)"


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    ev = read(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("part"))
    return ev, [x[0] for x in ev.select("event_type").distinct().collect() if x[0] != "view"]


def _state_blocks(spark: SparkSession, d: str) -> DataFrame:
    ev, states = _events(spark, d)
    return R.state_blocks(ev, "event_type", states, "event_id", ("part",))


QUERIES["state_blocks"] = _state_blocks
SQL["state_blocks"] = f"with {_EV} select part, state, support, start_lidx, start_ridx, stop_lidx, stop_ridx, stop_lidx - start_ridx + 1 size_min, case when start_lidx = -1 or stop_ridx = -1 then -1 else stop_ridx - start_lidx - 1 end size_max, start_lidx = -1 or stop_ridx = -1 is_marginal from (select part, any_value(st) state, count(*) support, coalesce(arg_min(coalesce(prev, -1), idx), -1) start_lidx, min(idx) start_ridx, max(idx) stop_lidx, coalesce(arg_max(coalesce(nxt, -1), idx), -1) stop_ridx from rn group by part, run)"


def _state_transitions(spark: SparkSession, d: str) -> DataFrame:
    ev, states = _events(spark, d)
    return R.state_transitions(ev, "event_type", states, "event_id", ("part",))


QUERIES["state_transitions"] = _state_transitions
SQL["state_transitions"] = f"with {_EV} select part, lstate, rstate, lidx, ridx from (select part, lag(st) over (partition by part order by idx) lstate, st rstate, coalesce(prev, -1) lidx, idx ridx from lg) where lstate is null or lstate <> rstate union all select part, st, null, idx, -1 from lg where nxt is null"

#: Integrated homozygosity over gaps of 10 bases: ``of`` has vidx, class c, direction d and suffix length of each pair.
_IHH = (
    "hs as (select vidx, c, d, ssl l, count(*) k from of_pairs group by all), "
    "tot as (select vidx, c, d, sum(k) n, max(l) top, case when d = 0 then vidx else (select max(vidx) from g) - vidx end steps from hs group by all), "
    "gr as (select vidx, c, d, n, unnest(range(0, least(steps, top)::bigint + 1)) l from tot), "
    "eh as (select vidx, c, d, l, (n - sum(coalesce(k, 0)) over (partition by vidx, c, d order by l)) / n::double ehh from gr left join hs using (vidx, c, d, l)), "
    "ed as (select *, lag(ehh) over (partition by vidx, c, d order by l) prev, min(case when ehh <= 0.05 then l end) over (partition by vidx, c, d) e from eh), "
    "ih as (select vidx, c, d, coalesce(sum(10 * (ehh + prev) / 2) filter (where l > 0 and (e is null or l <= e)), 0) ihh from ed group by all), "
    "rt as (select vidx, sum(ihh) filter (where c = 0) s0, count(*) filter (where c = 0) n0, sum(ihh) filter (where c = 1) s1, count(*) filter (where c = 1) n1 from ih group by vidx)"
)
_POP_PAIRS = _NSL.replace("p.hidx < q.hidx)", "p.hidx < q.hidx and (p.hidx < 20) = (q.hidx < 20))")


@on_grid("ihs", "select v.vidx, round(case when n0 = 2 and n1 = 2 and s0 > 0 and s1 > 0 then ln(s1 / s0) end, 9) ihs from (select distinct vidx from g) v left join rt using (vidx)", f"{_NSL}, of_pairs as (select vidx, u c, 0 d, f ssl from ss where u = w and u >= 0 union all select vidx, u, 1, b from ss where u = w and u >= 0), {_IHH}")
def _(df):
    return H.ihs(df, include_edges=True, min_maf=0.0).withColumn("ihs", r("ihs"))


@on_grid("xpehh", "select vidx, round(case when s0 > 0 and s1 > 0 then ln(s0 / s1) end, 9) xpehh from rt", f"{_POP_PAIRS}, of_pairs as (select vidx, (hi >= 20)::int c, 0 d, f ssl from ss union all select vidx, (hi >= 20)::int, 1, b from ss), {_IHH}")
def _(df):
    return H.xpehh(df.select("vidx", "pos", F.slice("h", 1, 20).alias("h1"), F.slice("h", 21, 20).alias("h2")), "h1", "h2", include_edges=True).withColumn("xpehh", r("xpehh"))


@on_grid("xpnsl", "select vidx, round(case when m0 > 0 and m1 > 0 then ln(m0 / m1) end, 9) xpnsl from (select vidx, avg(f + b) filter (where hi < 20) m0, avg(f + b) filter (where hi >= 20) m1 from ss group by vidx)", _POP_PAIRS)
def _(df):
    return H.xpnsl(df.select("vidx", F.slice("h", 1, 20).alias("h1"), F.slice("h", 21, 20).alias("h2")), "h1", "h2").withColumn("xpnsl", r("xpnsl"))


# ---------------------------------------------------------------- without SQL


@on_grid("locate_unlinked", "")
def _(df):
    return P.locate_unlinked(_gn(df), 50, 10, 0.2)


@on_grid("phase_by_transmission", "")
def _(df):
    return M.phase_by_transmission(df.select("vidx", "gt"), 10)


@on_grid("roh_poissonhmm", "")
def _(df):
    return R.roh_poissonhmm(df, _contig_size(df), phet_roh=0.005, phet_nonroh=(0.02, 0.05), window_size=100)


@on_grid("roh_mhmm", "")
def _(df):
    return R.roh_mhmm(df, _contig_size(df), phet_roh=0.005, phet_nonroh=(0.02, 0.05), transition=0.001)
