"""Language-model scoring with a hidden Markov model.

Every token belongs to a class (the end token's own, or a hash of a word's last bytes).
Latent states emit classes, and a class emits its words by their training counts:

    log10 P(text) = log10 P_hmm(classes) + sum over tokens of log10 (c + 1) / (N_class + V_class + 1)

Unseen words share the last unit of their class. So the tables that travel to executors
have ``STATES x CLASSES`` entries whatever the vocabulary, while counts of words cover
the whole corpus: distinct word keys of each chunk meet in hash buckets, and the global
count of each goes back to the chunk.

Training is Baum-Welch over all training documents, cut into segments of bounded length:
every partition gives expected counts of starts, transitions and emissions, which are
added up in two steps and normalised. A segment from the middle of a text begins in the
long-run shares of the states and counts as no start. Scoring runs the scaled forward recursion over whole documents,
in step for all documents of a batch, and sums the logarithms of the scales: the exact
likelihood of the class sequence.

Edge cases: null and empty texts are the end token alone; a null id is no held-out id;
repeated rows count as often as they occur; without training documents all tokens are
unknown; an empty table gives an empty result; long texts are learned from and scored
whole; columns other than id and text are not read, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.chunks import KEY_SCHEMA, Chunk, group_starts, key_batch, mix, pack_chunks, read_chunks, slices_of, span_hash, split_words, with_replies
from varispark.llm.chunks import prefix_hash as prefix
from varispark.session import materialise

STATES = 8
CLASSES = 4096
ROUNDS = 5
#: Tokens of a training segment, and segments that run in step.
_SEGMENT, _STEP = 256, 512
_END_KEY = np.uint64(0x6A09E667F3BCC908)


def is_held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


class Tokens:
    """Token keys and classes of a chunk, each document closed by an end token."""

    def __init__(self, c: Chunk, classes: int):
        w = split_words(c, lower=True)
        data = np.where((c.data >= 65) & (c.data <= 90), c.data + np.uint8(32), c.data)
        tail = span_hash(prefix(data, 1), np.maximum(w.starts, w.ends - 3), w.ends, 1)
        kind = 1 + (tail % np.uint64(classes - 1)).astype(np.int64)
        end = np.cumsum(w.counts) + np.arange(len(c))
        n = len(w.hashes) + len(c)
        word = np.ones(n, bool)
        word[end] = False
        self.keys = np.full(n, _END_KEY)
        self.keys[word] = w.hashes
        self.kinds = np.zeros(n, np.uint16)
        self.kinds[word] = kind
        self.counts = w.counts + 1
        self.doc = np.repeat(np.arange(len(c)), self.counts)


def _distinct(c: Chunk, t: Tokens, learn: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of (bucket, key): bucket, key, class, training count; and the place of each token's key."""
    bucket = mix(t.keys) & np.uint64(n_buckets - 1)
    order = np.lexsort((t.keys, bucket))
    k = t.keys[order]
    first = group_starts(k)
    place = np.empty(len(k), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
    counts = np.bincount(place, learn[t.doc], minlength=len(first)).astype(np.uint32)
    return bucket[order][first], k[first], t.kinds[order][first], counts, place


def _add_up(payloads: list[bytes], classes: int) -> tuple[list[bytes], bytes]:
    """Global counts for each payload, and (N, V) of every class in this bucket."""
    sizes = [len(p) // 14 for p in payloads]
    read = lambda kind, width, at: np.concatenate([np.frombuffer(p, kind, n, at * n) for p, n in zip(payloads, sizes, strict=True)])
    keys, counts, kinds = read(np.uint64, 8, 0), read(np.uint32, 4, 8), read(np.uint16, 2, 12)
    order = np.argsort(keys, kind="stable")
    first = group_starts(keys[order])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
    kind = kinds[order][first]
    stats = np.stack([np.bincount(kind, total, classes), np.bincount(kind, total > 0, classes)]).astype(np.int64)
    cuts = np.cumsum(sizes)[:-1]
    return [x.tobytes() for x in np.split(out, cuts)], stats.tobytes()


def _sum_blobs(df: DataFrame, kind: str) -> np.ndarray | None:
    """Add up binary vectors (salt, blob) in two steps; one vector comes to the driver."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), kind) for b in t.column("blob"))
        return pa.table({"salt": pa.array([0], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    schema = "salt int, blob binary"
    rows = df.groupBy("salt").applyInArrow(add, schema).groupBy("salt").applyInArrow(add, schema).collect()
    return np.frombuffer(bytes(rows[0]["blob"]), kind) if rows else None


class Hmm:
    """Start, transition and emission probabilities, with the passes that use them."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)

    @classmethod
    def initial(cls, class_counts: np.ndarray, states: int, seed: int = 11) -> Hmm:
        r = np.random.default_rng(seed)
        base = class_counts + 0.5
        emit = base * r.uniform(0.5, 1.5, (states, len(base)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, class_counts: np.ndarray, states: int) -> Hmm:
        classes = len(class_counts)
        start, move, emit = counts[:states], counts[states : states + states**2].reshape(states, states), counts[states + states**2 :].reshape(states, classes)
        base = class_counts + 0.5
        emit = emit + base / base.sum() * (1e-3 * emit.sum(1, keepdims=True) + 1)
        start, move = start + 0.1, move + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def stationary(self) -> np.ndarray:
        """Shares of the states in a long text."""
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            p = p @ self.move.astype(np.float64)
        return (p / p.sum()).astype(np.float32)

    def expected_counts(self, batches: Iterator[np.ndarray]) -> np.ndarray:
        """Baum-Welch counts over class sequences: starts, transitions, emissions."""
        k, classes = self.emit.shape
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
        by_class = np.ascontiguousarray(self.emit.T)
        anywhere = self.stationary()
        for o, opens in _segments(batches):
            t, d = o.shape
            live = o >= 0
            b = by_class[np.maximum(o, 0)]
            alpha = np.empty((t, d, k), np.float32)
            scale = np.empty((t, d, 1), np.float32)
            # a segment from the middle of a text starts in any state, and is no start
            a = np.where(opens[:, None], self.start, anywhere) * b[0]
            for i in range(t):
                if i:
                    a = (alpha[i - 1] @ self.move) * b[i]
                scale[i] = a.sum(1, keepdims=True)
                alpha[i] = a / scale[i]
            beta = np.ones((d, k), np.float32)
            follow = np.empty((t, d, k), np.float32)  # b * beta / scale, from the right
            gamma = np.empty((t, d, k), np.float32)
            for i in range(t - 1, -1, -1):
                gamma[i] = alpha[i] * beta * live[i, :, None]
                f = b[i] * beta / scale[i]
                follow[i] = f * live[i, :, None]
                beta = np.where(live[i, :, None], f @ self.move.T, beta)
            start += gamma[0][opens].sum(0)
            move += self.move * (alpha[:-1].reshape(-1, k).T @ follow[1:].reshape(-1, k))
            at = o[live]
            g = gamma[live]
            for s in range(k):
                emit[s] += np.bincount(at, g[:, s], classes)
        return np.concatenate([start, move.ravel(), emit.ravel()])

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Of whole class sequences, by the scaled forward recursion in step."""
        out = np.zeros(len(sequences))
        if not sequences:
            return out
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sizes = np.array([len(sequences[i]) for i in order])
        flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
        first = np.append(0, np.cumsum(sizes)[:-1])
        by_class = np.ascontiguousarray(self.emit.T)
        total = np.zeros(len(order))
        product = np.ones(len(order))
        alpha = np.tile(self.start, (len(order), 1))
        for t in range(sizes[0]):
            n = int(np.searchsorted(-sizes, -t))  # the sequences longer than t
            a = alpha[:n] if not t else alpha[:n] @ self.move
            a = a * by_class[flat[first[:n] + t]]
            s = a.sum(1)
            alpha = a / s[:, None]
            product[:n] *= s
            if t % 16 == 15:
                total[:n] += np.log10(product[:n])
                product[:n] = 1
        total += np.log10(product)
        out[order] = total
        return out


def _segments(batches: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class sequences in segments, (time, segments) with -1 after the end of a segment, and which of them open a text."""
    held: list[tuple[np.ndarray, bool]] = []

    def drain() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held.sort(key=lambda x: len(x[0]), reverse=True)
        for i in range(0, len(held), _STEP):
            yield _columns(held[i : i + _STEP])
        held.clear()

    for seq in batches:
        held.extend((seq[i : i + _SEGMENT], i == 0) for i in range(0, len(seq), _SEGMENT))
        if len(held) >= 8 * _STEP:
            yield from drain()
    yield from drain()


def _columns(part: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    o = np.full((len(part[0][0]), len(part)), -1, np.int64)
    for j, (s, _) in enumerate(part):
        o[: len(s), j] = s
    return o, np.array([x for _, x in part])


_ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, word_score double, classes binary"


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32(id as text) mod ``modulus`` is not ``remainder``.
    """
    chunks = pack_chunks(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), carry=False)
    nb = chunks.n_buckets

    def learn(c: Chunk) -> np.ndarray:
        return np.array([not is_held_out(i, modulus, remainder) for i in c.id_array.to_pylist()], bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in read_chunks(b):
                bucket, keys, kinds, counts, _ = _distinct(c, Tokens(c, classes), learn(c), nb)
                yield key_batch([(x, c.chunk_id, keys[i:j].tobytes() + counts[i:j].tobytes() + kinds[i:j].tobytes()) for x, i, j in slices_of(bucket, nb)])

    def totals(key: tuple, t: pa.Table) -> pa.Table:
        replies, stats = _add_up(t.column("payload").to_pylist(), classes)
        b = key[0].as_py()
        ids = [*t.column("chunk_id").to_pylist(), -1 - b % 64]
        return pa.table({"chunk_id": pa.array(ids, pa.int64()), "bucket": pa.array([b] * len(ids), pa.int32()), "payload": pa.array([*replies, stats], pa.binary())})

    counted = materialise(chunks.table.mapInArrow(count, KEY_SCHEMA).groupBy("bucket").applyInArrow(totals, "chunk_id bigint, bucket int, payload binary"))
    sums = _sum_blobs(counted.where("chunk_id < 0").select(F.col("chunk_id").cast("int").alias("salt"), F.col("payload").alias("blob")).withColumn("salt", -F.col("salt")), "i8")
    sums = np.zeros((2, classes), np.int64) if sums is None else sums.reshape(2, classes)
    n_train, v_train = int(sums[0].sum()), int(sums[1].sum())
    class_total = np.log10((sums[0] + sums[1] + 1).astype(np.float64))
    base_total = np.log10(n_train + v_train + 1)

    def encode(c: Chunk, replies: list[tuple[int, bytes]]) -> pa.Table:
        t = Tokens(c, classes)
        *_, place = _distinct(c, t, learn(c), nb)
        known = np.concatenate([np.frombuffer(p, np.int64) for _, p in sorted(replies)])[place]
        log = np.log10(known + 1.0)
        # the end token is the only one of its class
        own = np.where(t.kinds == 0, 0.0, log - class_total[t.kinds])
        n = len(c)
        add = lambda x: np.bincount(t.doc, x, n)
        cuts = np.cumsum(t.counts)[:-1]
        return pa.table({
            "doc_id": c.id_array, "held_out": pa.array(~learn(c)), "n_tokens": pa.array(t.counts, pa.int64()),
            "n_known": pa.array(add(known > 0).astype(np.int64)), "base_score": pa.array(add(log - base_total)),
            "word_score": pa.array(add(own)), "classes": pa.array([x.tobytes() for x in np.split(t.kinds, cuts)], pa.binary()),
        })

    encoded = materialise(with_replies(chunks, counted.where("chunk_id >= 0"), encode, _ENCODED))
    model = Hmm.initial(sums[0].astype(float), states)
    for _ in range(rounds):
        model = _baum_welch(encoded, model, sums[0].astype(float), states)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                found = model.log10_likelihood([np.frombuffer(x.as_buffer(), np.uint16) for x in part.column("classes")])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(found + part.column("word_score").to_numpy())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = encoded.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")


def _baum_welch(encoded: DataFrame, model: Hmm, class_counts: np.ndarray, states: int) -> Hmm:
    """One round: expected counts of every partition, added up, normalised."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.expected_counts(np.frombuffer(x.as_buffer(), np.uint16) for b in batches for x in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 128], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["salt", "blob"])

    got = _sum_blobs(encoded.where("not held_out").select("classes").mapInArrow(expect, "salt int, blob binary"), "f8")
    return model if got is None or not got.any() else Hmm.from_counts(got, class_counts, states)
