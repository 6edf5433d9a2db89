"""Run lengths of states along an index, and runs of homozygosity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varispark.operators import windows as W


def _listed(df: DataFrame, state: str, states: Sequence, idx: str) -> DataFrame:
    return df.where(F.col(state).isin(list(states))).select(F.col(idx).alias("idx"), F.col(state).alias("state"), *(["pos"] if "pos" in df.columns and idx != "pos" else []))


def state_transitions(df: DataFrame, state: str, states: Sequence, idx: str = "vidx", by: tuple[str, ...] = ()) -> DataFrame:
    """(lstate, rstate, lidx, ridx) of every change between listed states; others are skipped. Ends have NULL states and index -1."""
    keep = df.where(F.col(state).isin(list(states)))
    w = Window.partitionBy(*by).orderBy(idx)
    rows = keep.select(*by, F.lag(state).over(w).alias("lstate"), F.col(state).alias("rstate"), F.lag(idx).over(w).alias("lidx"), F.col(idx).alias("ridx"), F.lead(idx).over(w).alias("nxt"))
    change = rows.where(F.col("lstate").isNull() | (F.col("lstate") != F.col("rstate"))).select(*by, "lstate", "rstate", F.coalesce("lidx", F.lit(-1)).alias("lidx"), "ridx")
    end = rows.where("nxt is null").select(*by, F.col("rstate").alias("lstate"), F.lit(None).cast(rows.schema["rstate"].dataType).alias("rstate"), F.col("ridx").alias("lidx"), F.lit(-1).cast("bigint").alias("ridx"))
    return change.unionByName(end)


def state_blocks(df: DataFrame, state: str, states: Sequence, idx: str = "vidx", by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of listed states: state, support, start_lidx, start_ridx, stop_lidx, stop_ridx, size_min, size_max, is_marginal."""
    keep = df.where(F.col(state).isin(list(states))).select(*by, F.col(idx).alias("idx"), F.col(state).alias("state"))
    w = Window.partitionBy(*by).orderBy("idx")
    rows = keep.withColumn("prev", F.lag("idx").over(w)).withColumn("next", F.lead("idx").over(w)).withColumn("new", F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w))
    got = rows.groupBy(*by, "run").agg(F.first("state").alias("state"), F.count("*").alias("support"), F.coalesce(F.min_by("prev", "idx"), F.lit(-1)).alias("start_lidx"), F.min("idx").alias("start_ridx"), F.max("idx").alias("stop_lidx"), F.coalesce(F.max_by("next", "idx"), F.lit(-1)).alias("stop_ridx"))
    marginal = (F.col("start_lidx") == -1) | (F.col("stop_ridx") == -1)
    return got.select(*by, "state", "support", "start_lidx", "start_ridx", "stop_lidx", "stop_ridx", (F.col("stop_lidx") - F.col("start_ridx") + 1).alias("size_min"), F.when(marginal, -1).otherwise(F.col("stop_ridx") - F.col("start_lidx") - 1).alias("size_max"), marginal.alias("is_marginal"))


def transition_matrix(t: float, n: int) -> np.ndarray:
    return np.where(np.eye(n, dtype=bool), 1 - t, t / (n - 1))


def emission_matrix(het: np.ndarray, p_accessible: float) -> np.ndarray:
    """A row a state: chances of a base without het call, of a het call, and of one that is not observed."""
    return np.stack([(1 - het) * p_accessible, het * p_accessible, np.full(len(het), 1 - p_accessible)], 1)


def _viterbi_runs(log_start, log_move, steps: list[tuple[np.ndarray, int]]) -> list[tuple[int, int]]:
    """Best states for observations given as (log emission, repeats): (state, length) runs.

    Within a stretch of equal observations a path changes state at most once at its
    start without loss, so stretches are advanced as a whole.
    """
    k = len(log_start)
    score, back = None, []
    for e, n in steps:
        if score is None:
            into, came = log_start + e, np.arange(k)
        else:
            m = score[:, None] + log_move
            came = m.argmax(0)
            into = m[came, np.arange(k)] + e
        back.append(came)
        score = into + (n - 1) * (e + np.diag(log_move))
    s = int(np.argmax(score))
    path = []
    for (_, n), came in zip(reversed(steps), reversed(back), strict=True):
        path.append((s, n))
        s = int(came[s])
    return path[::-1]


def _blocks(runs: list[tuple[int, int]], first: int, scale: int) -> list[tuple[int, int, int]]:
    """(state, start, stop) of merged runs in coordinates."""
    out: list[list[int]] = []
    at = first
    for s, n in runs:
        if out and out[-1][0] == s:
            out[-1][2] += n * scale
        else:
            out.append([s, at, at + n * scale - 1])
        at += n * scale
    return [tuple(x) for x in out]


_ROH_SCHEMA = "sidx int, start bigint, stop bigint, length bigint, is_marginal boolean, froh double"


def _roh(df: DataFrame, each: DataFrame, decode, contig_size: int, min_roh: int, gt: str, inclusive: bool) -> DataFrame:
    """Decode every sample on its own: its het calls, and the rows of ``each``, pass through one task.

    A sample without a run has one row, whose run is NULL and whose ``froh`` is 0.
    """

    def run(key: tuple, calls: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sidx = int(rows["sidx"].iloc[0]) if len(rows) else int(calls["sidx"].iloc[0])
        found = [(a, b) for s, a, b in decode(np.sort(calls["at"].to_numpy()), rows) if s == 0]
        found = [(a, b, b - a + 1 if inclusive else b - a) for a, b in found]
        found = [r for r in found if r[2] >= min_roh]
        froh = sum(r[2] for r in found) / contig_size
        out = [(sidx, a, b, n, a <= 1 or b >= contig_size, froh) for a, b, n in found] or [(sidx, None, None, None, None, 0.0)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ROH_SCHEMA.split(", ")]).astype({"start": "Int64", "stop": "Int64", "length": "Int64", "is_marginal": "boolean"})

    het = F.forall("g", lambda a: a >= 0) & F.exists("g", lambda a: a != F.col("g")[0])
    calls = df.select("pos", F.posexplode(gt).alias("sidx", "g")).where(het)
    calls = calls.select("sidx", F.col("pos").alias("at"))
    return calls.groupBy("sidx").cogroup(each.groupBy("sidx")).applyInPandas(run, _ROH_SCHEMA)


def _for_samples(df: DataFrame, gt: str, rows: DataFrame | None) -> DataFrame:
    """``rows`` once for every sample; without rows, one row a sample."""
    n = df.agg(F.max(F.size(gt))).first()[0] or 0
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")).alias("sidx")
    return df.sparkSession.range(1).select(each) if rows is None else rows.select(each, *rows.columns)


def roh_mhmm(df: DataFrame, contig_size: int, phet_roh: float = 0.001, phet_nonroh: Sequence[float] = (0.0025, 0.01), transition: float = 1e-6, min_roh: int = 0, gt: str = "gt", accessible: DataFrame | None = None) -> DataFrame:
    """Runs of homozygosity by a categorical HMM over every base (no variant, het, not observed), decoded by stretches.

    Bases outside the disjoint ``accessible`` intervals are not observed.
    """
    het = np.array([phet_roh, *phet_nonroh])
    k = len(het)
    move, start = np.log(transition_matrix(transition, k)), np.log(np.full(k, 1 / k))
    masked = accessible is not None
    share = (accessible.agg(F.sum(F.col("stop") - F.col("start") + 1)).first()[0] or 0) / contig_size if masked else 1.0
    with np.errstate(divide="ignore"):  # where all bases are accessible, or none, the other symbols don't occur
        no, yes, unseen = np.log(emission_matrix(het, share)).T

    def decode(pos: np.ndarray, mask: pd.DataFrame) -> list[tuple[int, int, int]]:
        ends = sorted(zip(mask["start"].tolist(), mask["stop"].tolist(), strict=True)) if masked else [(1, contig_size)]
        steps, at = [], 1

        def until(emission: np.ndarray, stop: int) -> None:
            nonlocal at
            if stop >= at:
                steps.append((emission, stop - at + 1))
                at = stop + 1

        for a, b in ends:
            until(unseen, min(a - 1, contig_size))
            for p in np.unique(pos[np.searchsorted(pos, at) : np.searchsorted(pos, b, "right")]).tolist():
                until(no, p - 1)
                until(yes, p)
            until(no, min(b, contig_size))
        until(unseen, contig_size)
        return _blocks(_viterbi_runs(start, move, steps), 1, 1) if steps else []

    each = _for_samples(df, gt, accessible.select("start", "stop") if masked else None)
    return _roh(df, each, decode, contig_size, min_roh, gt, True)


def roh_poissonhmm(df: DataFrame, contig_size: int, phet_roh: float = 0.001, phet_nonroh: Sequence[float] = (0.0025, 0.01), transition: float = 0.001, window_size: int = 1000, min_roh: int = 0, gt: str = "gt", accessible: DataFrame | None = None) -> DataFrame:
    """Runs of homozygosity by a Poisson HMM over counts of het calls in windows; lengths exclude the last base.

    With ``accessible`` intervals, each window has as many accessible bases.
    """
    rate = np.array([phet_roh, *phet_nonroh]) * window_size
    k = len(rate)
    move, start = np.log(transition_matrix(transition, k)), np.log(np.full(k, 1 / k))
    masked = accessible is not None

    def decode(pos: np.ndarray, rows: pd.DataFrame) -> list[tuple[int, int, int]]:
        if masked:
            rows = rows.sort_values("window_start")
            first, last = rows["window_start"].to_numpy(), rows["window_stop"].to_numpy()
        else:
            first = np.arange(1, contig_size + 1, window_size)
            last = np.minimum(first + window_size - 1, contig_size)
        if not len(first):
            return []
        w = np.searchsorted(first, pos, "right") - 1
        counts = np.bincount(w[(w >= 0) & (pos <= last[w])], minlength=len(first))
        factorial = np.cumsum(np.log(np.maximum(1, np.arange(counts.max() + 1))))
        blocks = _blocks(_viterbi_runs(start, move, [(c * np.log(rate) - rate - factorial[c], 1) for c in counts.tolist()]), 0, 1)
        return [(s, int(first[a]), int(last[b])) for s, a, b in blocks]

    windows = W.equally_accessible_windows(accessible, window_size).select("window_start", "window_stop") if masked else None
    return _roh(df, _for_samples(df, gt, windows), decode, contig_size, min_roh, gt, False)
