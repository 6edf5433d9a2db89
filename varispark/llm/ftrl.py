"""FTRL-proximal logistic regression over hashed word n-grams.

The learner keeps, for every hashed feature, a gradient sum and a squared-gradient sum:
each coordinate has its own falling rate, and the L1 term holds weights at exactly zero
until the evidence exceeds it. Labelled texts of a bounded sample are hashed where they
lie; their feature indexes stream through one task, once an epoch. What remains, some
thousand (index, weight) pairs of a fixed-size table, is sent to the executors, where
scoring is a sparse dot product in numpy.

Bounds: ``max_rows`` labelled rows are used at most (those with the smallest hash of
their id, so the choice does not depend on the partitioning), and the weights and the
indexes of a row number at most ``2 ** bits``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.llm.chunks import Chunk, mix, prefix_hash, span_hash, window_hash
from varispark.session import release_memory, ship_package

#: A function from a chunk to (document, feature hash) pairs; repeated pairs count once.
Features = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 2
    max_rows: int = 10_000


class Ftrl:
    """The learner; index 0 is the intercept, which has no L1."""

    def __init__(self, p: FtrlParams):
        self.p = p
        self.z = np.zeros(1 << p.bits)
        self.n = np.zeros(1 << p.bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[at]
        l1 = np.where(at == 0, 0.0, p.l1)
        excess = np.maximum(np.abs(z) - l1, 0)
        return -np.sign(z) * excess / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on the distinct feature indexes of a row; only nonzero weights need their roots."""
        z, n = self.z[at], self.n[at]
        on = np.flatnonzero((np.abs(z) > self.p.l1) | (at == 0))
        w = self.weights(at[on])
        g = _sigmoid(w.sum()) - label
        z += g
        z[on] -= (np.sqrt(n[on] + g * g) - np.sqrt(n[on])) / self.p.alpha * w
        self.z[at], self.n[at] = z, n + g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    is_word: np.ndarray
    prefix: np.ndarray


#: Character classes: 0 white space, 1 letter, digit or beyond ASCII, 2 any other.
_KIND = np.full(256, 2, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1


def tokens(c: Chunk, symbols: bool) -> Tokens:
    """Runs of word characters in lower case and, if asked for, runs of symbols."""
    data = np.where((c.data >= 65) & (c.data <= 90), c.data + np.uint8(32), c.data)
    kind = _KIND[data]
    if not symbols:
        kind = np.where(kind == 2, 0, kind)
    change = np.flatnonzero(np.diff(kind)) + 1
    starts = np.append(0, change)
    ends = np.append(change, len(data))
    on = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[on], ends[on]
    prefix = prefix_hash(data)
    hashes = span_hash(prefix, starts, ends)
    doc = np.searchsorted(c.starts, starts, "right") - 1
    return Tokens(starts, ends, hashes, doc, kind[starts] == 1, prefix)


def ngrams(t: Tokens, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n consecutive tokens."""
    h = window_hash(t.hashes, n, seed)
    inside = t.doc[: len(h)] == t.doc[n - 1 :] if len(h) else np.zeros(0, bool)
    return t.doc[: len(h)][inside], h[inside]


def stems(t: Tokens, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the first ``size`` bytes of every longer word: inflected forms share them."""
    on = np.flatnonzero(t.is_word & (t.ends - t.starts > size))
    return t.doc[on], mix(span_hash(t.prefix, t.starts[on], t.starts[on] + size) * np.uint64(seed) + np.uint64(size))


def skipgrams(t: Tokens, skip: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every two tokens with ``skip`` others between them."""
    n = max(0, len(t.hashes) - skip - 1)
    a, b = t.hashes[:n], t.hashes[skip + 1 :]
    inside = t.doc[:n] == t.doc[skip + 1 :]
    return t.doc[:n][inside], mix(a[inside] * np.uint64(seed) + b[inside] + np.uint64(skip))


def text_chunks(texts: pa.Array, size: int = 2 << 20) -> Iterator[Chunk]:
    """Binary texts in pieces of about ``size`` bytes, as chunks without ids."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)) + 1)
        raw = [x or b"" for x in texts.slice(at, to - at).to_pylist()]
        n = sizes[at:to]
        ends = np.cumsum(n + 1) - 1
        yield Chunk(0, np.zeros(len(raw), np.int64), np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), ends - n, ends, None, None, None)
        at = to


@dataclass
class FtrlModel:
    """Sparse weights and the features that they belong to."""

    features: Features
    bits: int
    index: np.ndarray
    weight: np.ndarray
    intercept: float
    _dense: np.ndarray | None = field(default=None, repr=False)

    def score_chunk(self, c: Chunk) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << self.bits, np.float32)
            self._dense[self.index] = self.weight
        doc, h = self.features(c)
        at = _slot(h, self.bits)
        on = np.flatnonzero(self._dense[at])  # few: the rest need no counting
        pair = np.unique(doc[on].astype(np.uint64) << np.uint64(self.bits) | at[on].astype(np.uint64))
        doc = (pair >> np.uint64(self.bits)).astype(np.int64)
        w = self._dense[(pair & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        return _sigmoid(self.intercept + np.bincount(doc, w, len(c)))

    def score(self, text: Column) -> Column:
        """Probability of label 1; null texts count as empty."""
        self._dense = None
        model = self

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            parts = [model.score_chunk(c) for c in text_chunks(texts)]
            release_memory()
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

        return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return np.maximum(1, (h >> np.uint64(64 - bits)).astype(np.int64))


def slots(texts: pa.Array, features: Features, bits: int) -> Iterator[np.ndarray]:
    """The distinct feature indexes of each text."""
    for c in text_chunks(texts):
        doc, h = features(c)
        pair = np.unique(doc.astype(np.uint64) << np.uint64(bits) | _slot(h, bits).astype(np.uint64))
        owner = (pair >> np.uint64(bits)).astype(np.int64)
        slot = (pair & np.uint64((1 << bits) - 1)).astype(np.int32)
        cut = np.searchsorted(owner, np.arange(len(c) + 1))
        for d in range(len(c)):
            yield slot[cut[d] : cut[d + 1]]


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, params: FtrlParams, id_col: str = "doc_id", text_col: str = "text") -> FtrlModel:
    """Fit on labelled documents. Rows without a label, an id or a document are left out; of several labels of an id the largest counts."""
    ship_package(docs.sparkSession)
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # at most max_rows pairs of numbers: their size is bounded, so they may be broadcast
    chosen = one.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(params.max_rows)
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(docs[id_col].alias("doc_id"), text).join(F.broadcast(chosen), "doc_id").select("text", "label", "turn")

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(slots(b.column("text"), features, params.bits))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("turn"), pa.array([x.tobytes() for x in got], pa.binary())], ["label", "turn", "slots"])
        release_memory()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Ftrl(params)
        for b in batches:
            for x, y in zip(b.column("slots"), b.column("label").to_pylist(), strict=True):
                learner.learn(np.append(0, np.frombuffer(x.as_buffer(), np.int32)), y)
        w = learner.weights(np.arange(1 << params.bits))
        on = np.flatnonzero(w)
        on = on[on > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(0, on), pa.int32()), pa.array(np.append(w[0], w[on]), pa.float64())], ["i", "w"])

    hashed = rows.mapInArrow(hash_texts, "label int, turn bigint, slots binary").repartition(1)
    # the pass of each epoch sorts the same rows, with spill, so no epoch is held in memory
    epochs = hashed.select("label", "turn", "slots", F.explode(F.sequence(F.lit(1), F.lit(params.epochs))).alias("epoch"))
    got = epochs.sortWithinPartitions("epoch", "turn", "slots").select("label", "slots").mapInArrow(run, "i int, w double").toArrow()
    index, weight = got.column("i").to_numpy(), got.column("w").to_numpy()
    if not len(index):
        index, weight = np.zeros(1, np.int32), np.zeros(1)
    return FtrlModel(features, params.bits, index[1:].astype(np.int64), weight[1:].astype(np.float32), float(weight[0]))


def with_scores(docs: DataFrame, model: FtrlModel, threshold: float, text_col: str = "text") -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted; own columns of these names are kept as ``<name>_input``."""
    score = model.score(docs[text_col])
    taken = {c.lower() for c in docs.columns}
    own = []
    for c in docs.columns:
        name = c
        while name.lower() in ("score", "predicted") or (name != c and name.lower() in taken):
            name += "_input"
        own.append(docs[f"`{c}`"].alias(name))
    out = docs.select(*own, score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_column: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text has the given remainder; false without an id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
