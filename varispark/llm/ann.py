"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample (``sample_rows``
vectors with the smallest hash of their id). Every vector is indexed: its nearest
centroid's list, and a code of the residual. A query visits the lists whose centroids
have the largest inner product with it; in a list, asymmetric distance tables (query
against codebooks) rank all codes, and the best are reranked with the original vectors
in double precision.

The result is exact. With each vector goes a bound on its distance from what its code
stands for, so the table's value tells how large the inner product can be (Cauchy and
Schwarz): whatever could still be among the nearest is scored with the original vectors.
A second round visits every further list whose bound, by its farthest vector, reaches the
score of the last one found.

Small lists are put together, and all are dealt in blocks of some thousand vectors, their
queries in blocks too; each pair of blocks is one group: a list that holds a third of all
vectors, or is visited by a third of all queries, is spread like any other. What travels to executors or the
driver has a bound: centroids, codebooks and the sizes of at most ``MAX_LISTS`` lists.

Edge cases: vectors that are null, zero, of another dimension than the most frequent one
(the smallest of equally frequent ones), or hold null or non-finite components take no
part, nor do rows without an id; rows of one id are different vectors: each is a
candidate for the other, and each is answered if it is a query, under the same
``query_id``; equal scores are ordered by smaller id; with fewer candidates than ``k`` all
are returned; an empty table gives an empty result; other columns are not read, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varispark.session import materialise, ship_package

MAX_LISTS = 4096
BLOCK = 4096
#: More than underflow in single precision takes from a product with a vector of length 1.
_TINY = 1e-30


@dataclass(frozen=True)
class IvfParams:
    k: int = 20
    sample_rows: int = 20_000
    #: Share of the lists that a query visits.
    probe_share: float = 0.75
    sub_vectors: int = 16
    codes: int = 256
    rerank: int = 128
    rounds: int = 8


@dataclass
class IvfModel:
    centroids: np.ndarray  # lists x dimension
    books: np.ndarray  # sub-vectors x codes x their dimension
    dimension: int

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, sub-vectors, their dimension), padded with zeros."""
        m, _, d = self.books.shape
        out = np.zeros((len(x), m * d), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, d)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.split(x - self.centroids[lists])
        return np.stack([_nearest(rest[:, i], self.books[i]) for i in range(rest.shape[1])], 1).astype(np.uint8)

    def bounds(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At most so far from its code, and from its centroid, lies each vector; rounding of single-precision products included."""
        m, d = self.books.shape[0], self.dimension
        centre = self.centroids[lists].astype(np.float64)
        parts = self.books[np.arange(m), codes].astype(np.float64)
        slack = 4 * (d + m) * float(np.finfo(np.float32).eps)
        far = np.linalg.norm(x - centre, axis=1)
        err = np.linalg.norm(x - centre - parts.reshape(len(x), -1)[:, :d], axis=1)
        size = np.linalg.norm(centre, axis=1)
        tables = np.linalg.norm(parts, axis=2).sum(1)
        return (err + slack * (err + size + tables)) + _TINY, (far + slack * (far + size)) + _TINY


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(part @ centres.T - half, 1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, np.int64)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[r.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        at = _nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], np.append(0, np.cumsum(size[full])[:-1]), axis=0)
        centres = centres.copy()
        centres[full] = sums / size[full, None]
    return centres.astype(np.float32)


def fit(sample: np.ndarray, n_rows: int, p: IvfParams) -> IvfModel:
    d = sample.shape[1]
    lists = int(min(MAX_LISTS, max(1, 2 ** round(np.log2(max(1.0, n_rows) ** 0.5))), max(1, len(sample) // 16)))
    centroids = _k_means(sample, lists, p.rounds, 1)
    m = min(p.sub_vectors, d)
    model = IvfModel(centroids, np.zeros((m, 1, -(-d // m)), np.float32), d)
    rest = model.split(sample - centroids[model.assign(sample)])
    books = [_k_means(rest[:, i], p.codes, p.rounds, 2 + i) for i in range(m)]
    most = max(map(len, books))
    model.books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books])
    return model


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _unit(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and their lengths."""
    top = np.abs(y).max(1, keepdims=True)
    length = np.linalg.norm(y / top, axis=1, keepdims=True)
    return y / top / length, (top * length)[:, 0]


def _matrix(column: pa.Array, d: int, kind=np.float32) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d).astype(kind)


def search(vectors: DataFrame, is_query: Column, params: IvfParams = IvfParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest by inner product, its own row excepted."""
    ship_package(vectors.sparkSession)
    p = params
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].alias("x"), is_query.alias("q")).where(F.col("vec_id").isNotNull())
    rows = rows.where(usable(F.col("x")))
    top = F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("count"), top.alias("top")).orderBy(F.desc("count"), "d").first()
    d, n_rows, top = (most["d"], most["count"], most["top"]) if most else (0, 0, 1.0)
    rows = rows.where(F.size("x") == d)
    sample = rows.select("x", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(p.sample_rows).select("x").toArrow().column("x").combine_chunks()
    if isinstance(sample, pa.ChunkedArray):
        sample = pa.concat_arrays(sample.chunks)
    result = "query_row bigint, query_id bigint, vec_id bigint, score double"
    if not len(sample):
        none = rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return none
    kind = rows.schema["x"].dataType.simpleString()
    # the index holds components between -1 and 1
    model = fit((_matrix(sample, d, np.float64) / top).astype(np.float32), n_rows, p)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for b in batches:
            row = np.arange(first, first + b.num_rows)
            first += b.num_rows
            x = _matrix(b.column("x"), d, np.float64) / top
            at = model.assign(x.astype(np.float32))
            codes = model.encode(x.astype(np.float32), at)
            err, far = model.bounds(x, at, codes)
            yield pa.RecordBatch.from_arrays([pa.array(row), b.column("vec_id"), b.column("x"), b.column("q"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(far)], ["row", "vec_id", "x", "q", "list", "code", "err", "far"])

    indexed = materialise(rows.mapInArrow(index, f"row bigint, vec_id bigint, x {kind}, q boolean, list int, code binary, err double, far double"))
    lists = len(model.centroids)
    sizes, radius = np.zeros(lists, np.int64), np.zeros(lists)
    for r in indexed.groupBy("list").agg(F.count("*").alias("count"), F.max("far").alias("far")).collect():  # at most MAX_LISTS rows
        sizes[r["list"]], radius[r["list"]] = r["count"], r["far"]
    # neighbouring lists together, up to a block
    group_of = np.cumsum(sizes) // BLOCK
    groups = int(group_of[-1]) + 1
    held = np.bincount(group_of, sizes, groups)
    probes = min(lists, int(np.ceil(p.probe_share * lists)))

    def probe(second: bool):
        """Which lists each query visits: the first, or all others that can hold one of its nearest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    unit, length = _unit(_matrix(part.column("x"), d, np.float64))
                    near = unit.astype(np.float32) @ model.centroids.T
                    order = np.argsort(-near, 1, kind="stable")
                    # further lists, where the first hold too few vectors
                    n = np.maximum(probes, (np.cumsum(sizes[order], 1) < 4 * (p.k + 1)).sum(1) + 1).clip(max=lists)
                    visited = np.zeros(order.shape, bool)
                    np.put_along_axis(visited, order, np.arange(lists) < n[:, None], 1)
                    if second:
                        least = part.column("least").to_numpy() / length / top
                        visited = ~visited & (near + radius >= least[:, None] - 1e-12 * np.abs(least[:, None]))
                    visited &= sizes > 0
                    to = np.zeros((len(n), groups), bool)
                    for g in range(groups):
                        to[:, g] = visited[:, group_of == g].any(1)
                    q, g = np.nonzero(to)
                    rows = pa.array(q)
                    bits = np.packbits(visited, axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("row").take(rows), part.column("vec_id").take(rows), part.column("x").take(rows), pa.array([bits[i].tobytes() for i in q], pa.binary()), part.column("least").take(rows), pa.array(g, pa.int32())], ["query_row", "query_id", "y", "lists", "least", "part"])

        return run

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _found([], [], [], [])
        a = a.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        x = _matrix(a.column("x").combine_chunks(), d, np.float64)
        # of equal vectors the first k are enough, and one more for a query among them
        seen: dict[bytes, int] = {}
        use = np.zeros(len(x), bool)
        for i, v in enumerate(x):
            key = v.tobytes()
            seen[key] = seen.get(key, 0) + 1
            use[i] = seen[key] <= p.k + 1
        a, x = a.filter(pa.array(use)), x[use]
        own, ids, of, err = (a.column(c).to_numpy() for c in ("row", "vec_id", "list", "err"))
        codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        queries, query_rows = b.column("query_id").to_numpy(), b.column("query_row").to_numpy()
        y = _matrix(b.column("y").combine_chunks(), d, np.float64)
        visited = np.unpackbits(np.frombuffer(b"".join(b.column("lists").to_pylist()), np.uint8).reshape(len(queries), -1), axis=1, count=lists).astype(bool)
        known = b.column("least").to_numpy()
        sizes_x = np.linalg.norm(x, axis=1)
        out = []
        for at in range(0, len(queries), 256):
            q, qid, qrow = y[at : at + 256], queries[at : at + 256], query_rows[at : at + 256]
            unit, length = _unit(q)
            single = unit.astype(np.float32)
            tables = np.einsum("qmd,mcd->mqc", model.split(single), model.books)
            guess = (single @ model.centroids.T)[:, of]
            for m in range(codes.shape[1]):
                guess += tables[m][:, codes[:, m]]
            hidden = ~visited[at : at + 256][:, of] | (own == qrow[:, None])
            guess[hidden] = -np.inf
            best = _largest(guess, p.rerank)
            score = _exact(q, x, np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()).reshape(best.shape)
            score[np.isneginf(np.take_along_axis(guess, best, 1))] = -np.inf
            least = known[at : at + 256]
            if best.shape[1] >= p.k:
                least = np.maximum(least, np.partition(score, -p.k, 1)[:, -p.k])
            # whatever can reach the last one so far, by its code's bound and then by products in any order of summation
            bar = least / length / top
            can = ~hidden & (guess + err >= (bar - 1e-12 * np.abs(bar))[:, None])
            some = np.flatnonzero(can.any(0))
            about = q @ x[some].T
            off = 4 * d * np.finfo(float).eps * length[:, None] * sizes_x[some]
            row, col = np.nonzero(can[:, some] & (about + off >= least[:, None]))
            if len(some) > p.k:
                low = np.where(can[:, some], about - off, -np.inf)
                last = np.partition(low, -p.k, 1)[:, -p.k]
                row, col = np.nonzero(can[:, some] & (about + off >= np.maximum(least, last)[:, None]))
            col = some[col]
            s = _exact(q, x, row, col)
            order = np.lexsort((ids[col], -s, row))
            row, col, s = row[order], col[order], s[order]
            on = np.arange(len(row)) - np.searchsorted(row, row) < p.k
            row, col, s = row[on], col[on], s[on]
            out.append((qrow[row], qid[row], ids[col], s))
        return _found(*(np.concatenate(c) for c in zip(*out, strict=True)))

    by_part = ["part", "block", "turn"]
    of_list = F.broadcast(indexed.sparkSession.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "list int, part int"))
    nearest = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")

    def visit(queries: DataFrame, second: bool) -> DataFrame | None:
        visits = materialise(queries.mapInArrow(probe(second), f"query_row bigint, query_id bigint, y {kind}, lists binary, least double, part int"))
        visitors = np.zeros(groups, np.int64)
        for r in visits.groupBy("part").count().collect():  # at most MAX_LISTS rows
            visitors[r["part"]] = r["count"]
        tiles = [(g, int(-(-h // BLOCK)), int(-(-v // BLOCK))) for g, (h, v) in enumerate(zip(held, visitors, strict=True)) if h and v]
        if not tiles:
            return None
        tiles = F.broadcast(indexed.sparkSession.createDataFrame(tiles, "part int, blocks int, turns int"))
        left = indexed.select("row", "vec_id", "x", "code", "list", "err").join(of_list, "list").join(tiles, "part")
        left = left.select("row", "vec_id", "x", "code", "list", "err", "part", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"))
        right = visits.join(tiles, "part")
        right = right.select("query_row", "query_id", "y", "lists", "least", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("query_row"), "turns").cast("int").alias("turn"))
        return left.groupBy(*by_part).cogroup(right.groupBy(*by_part)).applyInArrow(rank, result)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= p.k)

    queries = indexed.where("q").select("row", "vec_id", "x")
    none = F.lit(float("-inf"))
    found = visit(queries.withColumn("least", none), False)
    if found is None:
        found = indexed.sparkSession.createDataFrame([], result)
    found = materialise(ranked(found).drop("rank"))
    last = found.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == p.k)
    further = visit(queries.join(last, queries["row"] == last["query_row"], "left").select("row", "vec_id", "x", F.coalesce("score", none).alias("least")), True)
    return ranked(found if further is None else found.unionByName(further)).select("query_id", "rank", "vec_id", "score")


def _exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of rows of ``q`` and ``x``, summed in one order, so equal vectors have equal scores."""
    out = np.zeros(len(row))
    for at in range(0, len(row), 1 << 16):
        i, j = q[row[at : at + (1 << 16)]], x[col[at : at + (1 << 16)]]
        for c in range(q.shape[1]):
            out[at : at + (1 << 16)] += i[:, c] * j[:, c]
    return out


def _largest(guess: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; of equal ones the first."""
    n = guess.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), guess.shape)
    bits = guess.astype(np.float32).view(np.int32)
    bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
    key = bits.astype(np.int64) << 24 | (np.int64((1 << 24) - 1) - np.arange(n))
    return np.argpartition(key, n - k, 1)[:, n - k :]


def _found(r, q, v, s) -> pa.Table:
    return pa.table({"query_row": pa.array(r, pa.int64()), "query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})
