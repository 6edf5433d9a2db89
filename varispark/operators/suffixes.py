"""Shared suffix lengths of haplotype pairs, and what scans need of them, by blocks of variants.

The shared suffix length of a pair at a variant is its distance to the last variant
where both haplotypes are called and differ (in scans by class: or share another allele
than 0 and 1). Variants are packed into blocks of consecutive rows. A first pass tells
where each pair breaks last in each block; these states are carried from block to block
by chunks of pairs; a second pass starts each block from the state that reaches it. So
nothing but one state a pair and block crosses the network, and a task holds one block.

Integrated homozygosity needs no look back: a pair that last broke at b adds the way
from the middle of the gap behind b to the variant, and is cut at the (K + 1)-th longest
suffix, where the share of pairs still alike falls to ``min_ehh``; K is the largest count
of pairs that is no more than that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.operators import windows as W
from varispark.session import materialise, ship_package

#: Variants of a block, and pairs whose states pass from block to block in one task.
BLOCK = 4096
CHUNK = 256
#: Cells of variants x pairs that a task computes at once.
CELLS = 1 << 20

_DIRECTIONS = (0, 1)
_STATE = "direction int, chunk int, block bigint, first bigint, first_gap double, total double, holes bigint, last array<bigint>, place array<double>, middle array<double>, behind array<bigint>"
_CARRY = "direction int, chunk int, block bigint, last array<bigint>, place array<double>, middle array<double>, behind array<bigint>"


def ihh_gaps(df: DataFrame, pos: str = "pos", map_pos: str | None = None, gap_scale: int | None = 20_000, max_gap: int | None = 200_000, accessible: DataFrame | None = None) -> DataFrame:
    """(vidx, gap) from each variant to the next, NULL at the last.

    Gaps are scaled to their accessible bases if intervals are given, else wide ones to
    ``gap_scale``; those beyond ``max_gap`` are -1.
    """
    here = df.select("vidx", F.col(pos).alias("p"), F.col(map_pos or pos).cast("double").alias("m"))
    after = here.select((F.col("vidx") - 1).alias("vidx"), F.col("p").alias("q"), F.col("m").alias("o"))
    g = here.join(after, "vidx", "left")
    gap, physical = F.col("o") - F.col("m"), F.col("q") - F.col("p")
    if accessible is not None:
        ways = g.where("q is not null").select(F.col("vidx").alias("w"), F.col("p").alias("window_start"), (F.col("q") - 1).alias("window_stop"))
        g = g.join(W.accessible_bases(ways.where("window_start <= window_stop"), accessible).select(F.col("w").alias("vidx"), "n_bases"), "vidx", "left")
        gap = gap * F.coalesce(F.try_divide(F.col("n_bases"), physical), F.lit(0.0))
    elif gap_scale:
        gap = gap * F.when(physical > gap_scale, gap_scale / physical).otherwise(1.0)
    if max_gap:
        gap = F.when(physical > max_gap, -1.0).otherwise(gap)
    return g.select("vidx", gap.alias("gap"))


def pack_blocks(df: DataFrame, h: str, gaps: DataFrame | None = None) -> DataFrame:
    """A written row for each block: vidx, alleles, and the gaps before and after each variant. ``vidx`` counts from 0."""
    ship_package(df.sparkSession)
    rows = df.select("vidx", F.col(h).cast("array<tinyint>").alias("h"))
    if gaps is None:
        rows = rows.select("*", F.lit(0.0).alias("before"), F.lit(0.0).alias("after"))
    else:
        both = gaps.select("vidx", F.col("gap").alias("after"), F.lit(None).cast("double").alias("before"))
        both = both.unionByName(gaps.select((F.col("vidx") + 1).alias("vidx"), F.lit(None).cast("double").alias("after"), F.col("gap").alias("before")))
        both = both.groupBy("vidx").agg(F.coalesce(F.max("before"), F.lit(0.0)).alias("before"), F.coalesce(F.max("after"), F.lit(0.0)).alias("after"))
        rows = rows.join(both, "vidx")
    rows = rows.withColumn("block", F.floor(F.col("vidx") / BLOCK))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vidx")
        alleles = np.asarray(t.column("h").combine_chunks().flatten().fill_null(-1)).astype(np.int8)
        if alleles.size % t.num_rows:
            raise ValueError("haplotype arrays differ in length")
        cols = [t.column(c).to_numpy().tobytes() for c in ("vidx", "before", "after")]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "vidx": pa.array([cols[0]], pa.binary()), "before": pa.array([cols[1]], pa.binary()), "after": pa.array([cols[2]], pa.binary()), "alleles": pa.array([alleles.tobytes()], pa.binary())})

    return materialise(rows.groupBy("block").applyInArrow(pack, "block bigint, vidx binary, before binary, after binary, alleles binary"))


class _Block:
    """One block in the order of a scan: ``s`` rises by one along it, ``c`` is the way from the variant before it."""

    def __init__(self, t: pa.RecordBatch | pa.Table, at: int, reverse: int):
        raw = [np.frombuffer(t.column(c)[at].as_py(), k) for c, k in (("vidx", np.int64), ("after" if reverse else "before", np.float64), ("alleles", np.int8))]
        self.vidx, gap, self.h = raw[0], raw[1], raw[2].reshape(len(raw[0]), -1)
        if reverse:
            self.vidx, gap, self.h = self.vidx[::-1], gap[::-1], self.h[::-1]
        self.s = -self.vidx if reverse else self.vidx
        self.gap = np.maximum(gap, 0.0)
        self.c = np.cumsum(self.gap)
        self.holes = np.cumsum(gap < 0)
        self.middle = np.append((self.c[:-1] + self.c[1:]) / 2, self.c[-1:])
        self.i, self.j = np.triu_indices(self.h.shape[1], 1)
        self.step = max(1, CELLS // max(1, len(self.i)))

    def __len__(self) -> int:
        return len(self.s)

    def breaks(self, a: int, b: int, by_class: bool) -> np.ndarray:
        x, y = self.h[a:b, self.i], self.h[a:b, self.j]
        return (x >= 0) & (y >= 0) & ((x != y) | (x > 1) if by_class else x != y)


def _last_breaks(blocks: DataFrame, by_class: bool, directions: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(t.num_rows):
                for d in directions:
                    k = _Block(t, at, d)
                    last = np.full(len(k.i), -1)
                    for b in range(len(k), 0, -k.step):
                        a = max(0, b - k.step)
                        brk = k.breaks(a, b, by_class)
                        new = (last < 0) & brk.any(0)
                        last[new] = b - 1 - np.argmax(brk[::-1, new], 0)
                        if (last >= 0).all():
                            break
                    on = last >= 0
                    end = k.c[-1]
                    place = np.where(on, k.c[last] - end, np.nan)
                    # the middle behind a break at the last variant is known in the next block
                    middle = np.where(on, k.middle[last] - end, np.nan)
                    behind = np.where(on, k.holes[last] - k.holes[-1], 0)
                    s = np.where(on, k.s[last], np.iinfo(np.int64).max)
                    cuts = list(range(0, len(last), CHUNK))
                    n = len(cuts)
                    lists = lambda x: pa.array([x[c : c + CHUNK] for c in cuts])  # noqa: E731,B023
                    whole = lambda x, kind: pa.array([x] * n, kind)  # noqa: E731,B023
                    yield pa.RecordBatch.from_arrays([whole(d, pa.int32()), pa.array([c // CHUNK for c in cuts], pa.int32()), whole(t.column("block")[at].as_py(), pa.int64()), whole(int(k.s[0]), pa.int64()), whole(k.gap[0], pa.float64()), whole(end, pa.float64()), whole(int(k.holes[-1]), pa.int64()), lists(s).cast(pa.list_(pa.int64())), lists(place).cast(pa.list_(pa.float64())), lists(middle).cast(pa.list_(pa.float64())), lists(behind).cast(pa.list_(pa.int64()))], [x.split()[0] for x in _STATE.split(", ")])

    return blocks.mapInArrow(run, _STATE)


def _carried(states: DataFrame) -> DataFrame:
    """The state of each chunk of pairs in front of each block, blocks in the order of the scan."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("first").to_numpy())
        lists = {c: [np.asarray(x.values) for x in t.column(c)] for c in ("last", "place", "middle", "behind")}
        first, first_gap, total, holes, block = (t.column(c).to_numpy() for c in ("first", "first_gap", "total", "holes", "block"))
        width = len(lists["last"][0])
        start = first[order[0]] - 1
        last, place, middle, behind = np.full(width, start), np.zeros(width), np.zeros(width), np.zeros(width, np.int64)
        out: list[tuple] = []
        for k in order:
            middle = np.where((last == first[k] - 1) & (last != start), place + first_gap[k] / 2, middle)
            out.append((block[k], last, place, middle, behind))
            on = lists["last"][k] != np.iinfo(np.int64).max
            last = np.where(on, lists["last"][k], last)
            place = np.where(on, lists["place"][k], place - total[k])
            middle = np.where(on, lists["middle"][k], middle - total[k])
            behind = np.where(on, lists["behind"][k], behind - holes[k])
        cols = list(zip(*out, strict=True))
        arrays = [pa.array(list(c)).cast(pa.list_(kind)) for c, kind in zip(cols[1:], (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([key[1].as_py()] * len(out), pa.int32()), pa.array(list(cols[0]), pa.int64()), *arrays], [x.split()[0] for x in _CARRY.split(", ")])

    return states.groupBy("direction", "chunk").applyInArrow(run, _CARRY)


def _suffixes(k: _Block, carry: dict[str, np.ndarray], by_class: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, place of the last break of each pair in this block, or behind it if negative) by slices."""
    rel = (carry["last"] - k.s[0]).astype(np.int32)
    for a in range(0, len(k), k.step):
        b = min(a + k.step, len(k))
        at = np.where(k.breaks(a, b, by_class), np.arange(a, b, dtype=np.int32)[:, None], rel[None, :])
        at = np.maximum.accumulate(at, 0)
        rel = at[-1]
        yield a, b, at


def _classes(k: _Block, a: int, b: int) -> list[np.ndarray]:
    x, same = k.h[a:b, k.i], k.h[a:b, k.i] == k.h[a:b, k.j]
    return [same & (x == 0), same & (x == 1)]


def _most(n_pairs: int, share: float) -> np.ndarray:
    """For each n the largest count that is at most ``share`` of n."""
    n = np.arange(n_pairs + 1)
    some = np.maximum(n, 1)
    c = np.floor(share * n)
    c = np.where((c + 1) / some <= share, c + 1, c)
    return np.where(c / some > share, c - 1, c).astype(np.int64)


def _ihh(k: _Block, a: int, b: int, at: np.ndarray, member: np.ndarray, carry: dict[str, np.ndarray], most: np.ndarray, include_edges: bool, start: int) -> np.ndarray:
    n = member.sum(1)
    here = k.c[a:b]
    big = np.iinfo(np.int32).max
    turn = np.clip(most[n], 0, np.maximum(n - 1, 0))
    end = np.sort(np.where(member, at, big), 1)[np.arange(b - a), turn] if at.shape[1] else np.full(b - a, big)
    # where the homozygosity has fallen: a place in this block, or one that the states know
    rel = (carry["last"] - k.s[0]).astype(np.int64)
    order = np.argsort(rel, kind="stable")
    known = np.minimum(np.searchsorted(rel[order], end), max(0, len(order) - 1))
    inside = (end >= 0) & (end < big)
    local = np.where(inside, end, 0)
    cut = np.where(inside, k.c[local], carry["place"][order[known]])
    holes = np.where(inside, k.holes[local], carry["behind"][order[known]])
    middle = np.where(at >= 0, k.middle[np.maximum(at, 0)], carry["middle"][None, :])
    way = here[:, None] - np.maximum(np.minimum(middle, here[:, None]), cut[:, None])
    ihh = np.divide((way * member).sum(1), n, out=np.full(b - a, np.nan), where=n > 0)
    fine = (n > 0) & (k.holes[a:b] - holes == 0)
    if not include_edges:
        fine &= end != start - 1 - k.s[0]
    return np.where(fine, ihh, np.nan)


_STATS = ["n0", "ssl0", "ihh0", "n1", "ssl1", "ihh1"]


def _on_blocks(blocks: DataFrame, by_class: bool, directions: tuple[int, ...], f, schema: str) -> DataFrame:
    """Run ``f`` (block row, carry of each direction) on every block."""
    carry = _carried(_last_breaks(blocks, by_class, directions))

    def run(t: pa.Table, states: pa.Table) -> pa.Table:
        by: dict[int, dict[str, np.ndarray]] = {}
        for d in directions:
            mine = states.filter(pa.array(np.asarray(states.column("direction")) == d)).sort_by("chunk")
            by[d] = {c: np.concatenate([np.asarray(x.values) for x in mine.column(c)] or [np.zeros(0, np.int64)]) for c in ("last", "place", "middle", "behind")}
        return f(t, by)

    return blocks.groupBy("block").cogroup(carry.groupBy("block")).applyInArrow(run, schema)


def pair_stats(df: DataFrame, h: str, by_class: bool, gaps: DataFrame | None = None, min_ehh: float = 0.05, include_edges: bool = False) -> DataFrame:
    """vidx and, forwards (f) and backwards (r), of pairs of class 0 and 1 (or of all, in 0): number, sum of suffix lengths, and IHH if ``gaps`` are given."""
    blocks = pack_blocks(df, h, gaps)
    # the scans start at vidx 0 and at the last one; one number
    integrated = gaps is not None
    last = (df.agg(F.max("vidx")).first()[0] or 0) if integrated else 0

    def stats(t: pa.Table, by: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        out: dict[str, np.ndarray] = {}
        for d in _DIRECTIONS:
            k = _Block(t, 0, d)
            cols = {c: np.full(len(k), np.nan) for c in _STATS}
            most = _most(len(k.i), min_ehh)
            for a, b, at in _suffixes(k, by[d], by_class):
                members = _classes(k, a, b) if by_class else [np.ones(at.shape, bool)]
                length = np.arange(a, b)[:, None] - at
                for c, m in enumerate(members):
                    cols[f"n{c}"][a:b] = m.sum(1)
                    cols[f"ssl{c}"][a:b] = (length * m).sum(1)
                    if integrated:
                        cols[f"ihh{c}"][a:b] = _ihh(k, a, b, at, m, by[d], most, include_edges, -last if d else 0)
            for c, x in cols.items():
                out["fr"[d] + c] = x[::-1] if d else x
        names = ["fr"[d] + c for d in _DIRECTIONS for c in _STATS]
        return pa.table({"vidx": pa.array(_Block(t, 0, 0).vidx), **{c: pa.array(out[c], pa.float64(), from_pandas=True) for c in names}})

    schema = "vidx bigint, " + ", ".join(f"{'fr'[d]}{c} double" for d in _DIRECTIONS for c in _STATS)
    return _on_blocks(blocks, by_class, _DIRECTIONS, stats, schema)


def suffix_rows(df: DataFrame, h: str, reverse: bool, by_class: bool) -> DataFrame:
    """(vidx, i, j, cls, ssl) of every pair at every variant: the result has that many rows."""
    d = int(reverse)

    def rows(t: pa.Table, by: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        k, parts = _Block(t, 0, d), []
        for a, b, at in _suffixes(k, by[d], by_class):
            n = len(k.i)
            zero, one = _classes(k, a, b)
            cls = pa.array(np.where(one, 1, 0).ravel().astype(np.int32), mask=~(zero | one).ravel())
            length = (np.arange(a, b)[:, None] - at).astype(np.int64)
            parts.append(pa.table([pa.array(np.repeat(k.vidx[a:b], n)), pa.array(np.tile(k.i.astype(np.int32), b - a)), pa.array(np.tile(k.j.astype(np.int32), b - a)), cls, pa.array(length.ravel())], ["vidx", "i", "j", "cls", "ssl"]))
        return pa.concat_tables(parts)

    return _on_blocks(pack_blocks(df, h), by_class, (d,), rows, "vidx bigint, i int, j int, cls int, ssl bigint")


def first_differences(df: DataFrame, h: str) -> DataFrame:
    """(i, j, at): the first variant where the haplotypes of a pair differ, missing alleles too; no row for equal ones."""
    blocks = pack_blocks(df, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(t.num_rows):
                k = _Block(t, at, 0)
                first = np.full(len(k.i), -1)
                for a in range(0, len(k), k.step):
                    differ = k.h[a : a + k.step, k.i] != k.h[a : a + k.step, k.j]
                    new = (first < 0) & differ.any(0)
                    first[new] = a + np.argmax(differ[:, new], 0)
                    if (first >= 0).all():
                        break
                on = np.flatnonzero(first >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(k.i[on].astype(np.int32)), pa.array(k.j[on].astype(np.int32)), pa.array(k.vidx[first[on]])], ["i", "j", "at"])

    return blocks.mapInArrow(run, "i int, j int, at bigint").groupBy("i", "j").agg(F.min("at").alias("at"))
