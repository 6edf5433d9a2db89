"""Chunked documents and two-way exchanges of packed keys.

A chunk is one row that holds some megabytes of documents. Operators that compare
every window of every document with all others hash windows inside a chunk with
numpy, send each chunk's *distinct* keys to hash buckets as packed integers, and get
a reply for each chunk. A key that a third of all documents share is therefore sent
once a chunk and never once a document, and bytes on the wire are a few a word.

The chunk table is written once, bucketed by chunk id: replies travel to the chunks,
the text itself is never shuffled. Being written, it also keeps chunk ids the same
for every later pass, whichever executors run it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.session import materialise, ship_package, shuffle_partitions

#: Text bytes of a chunk; a longer document has a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Text bytes whose keys meet in one bucket.
BUCKET_BYTES = 16 << 20
#: A document without an id compares as the largest.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Chunks:
    """``table``: chunk_id, ids, texts, rest (one list element a document)."""

    table: DataFrame
    n_buckets: int
    rest: list[str]

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession


def pack_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: bool = True, prepare: Callable | None = None) -> Chunks:
    """Write ``docs`` as a bucketed table of chunks. Null texts become empty.

    Other columns travel along in ``rest`` if ``carry``. ``prepare`` maps the text column first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = docs[text_col].cast("string")
    if prepare is not None:
        text = prepare(text)
    rest = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    own = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.struct(F.lit(None).cast("int").alias("c0"))
    flat = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"), own.alias("rest"))
    kind = flat.schema["rest"].dataType.simpleString()
    schema = f"chunk_id bigint, n_bytes bigint, ids array<bigint>, texts array<binary>, rest array<{kind}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        seq, held, held_bytes = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, held_bytes
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.num_rows
            offsets = pa.array([0, n], pa.int32())
            cols = [pa.ListArray.from_arrays(offsets, t.column(c).chunk(0)) for c in ("id", "text", "rest")]
            out = pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([held_bytes], pa.int64()), *cols], ["chunk_id", "n_bytes", "ids", "texts", "rest"])
            seq, held, held_bytes = seq + 1, [], 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(pc.binary_length(b.column(1))).astype(np.int64)
            at = 0
            ends = np.cumsum(sizes)
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                to = int(np.searchsorted(ends, before + max(1, chunk_bytes - held_bytes))) + 1
                to = min(max(to, at + 1), b.num_rows)
                held.append(b.slice(at, to - at))
                held_bytes += int(ends[to - 1] - before)
                at = to
                if held_bytes >= chunk_bytes:
                    yield flush()
        if held:
            yield flush()

    n = shuffle_partitions(spark)
    table = materialise(flat.mapInArrow(pack, schema), buckets=n, key="chunk_id")
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    want = max(total // BUCKET_BYTES, 4 * n)
    return Chunks(table.drop("n_bytes"), 1 << int(want - 1).bit_length(), rest)


@dataclass
class Chunk:
    """A chunk in numpy: the texts joined by a newline, and where each begins."""

    chunk_id: int
    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: pa.Array
    id_array: pa.Array
    rest: pa.Array

    def __len__(self) -> int:
        return len(self.ids)


def read_chunks(t: pa.RecordBatch | pa.Table) -> Iterator[Chunk]:
    for i in range(t.num_rows):
        ids, texts, rest = (t.column(c)[i].values for c in ("ids", "texts", "rest"))
        n = len(texts)
        raw = texts.to_pylist()
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        yield Chunk(t.column("chunk_id")[i].as_py(), np.asarray(ids.fill_null(int(NO_ID))), data, ends - sizes, ends, texts, ids, rest)


def exchange(chunks: Chunks, keys: DataFrame, reduce: Callable[[list[np.ndarray], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Group packed ``keys`` (bucket, chunk_id, payload) by bucket and reply to the chunks.

    ``reduce`` gets the chunk ids and payloads of a bucket and yields (index of a payload, reply).
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("chunk_id").to_numpy()
        out = [(i, r) for i, r in reduce(t.column("payload").to_pylist()) if r]
        at = [i for i, _ in out]
        return pa.table({"chunk_id": pa.array(ids[at], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(at), pa.int32()), "payload": pa.array([r for _, r in out], pa.binary())})

    return keys.groupBy("bucket").applyInArrow(run, "chunk_id bigint, bucket int, payload binary")


def with_replies(chunks: Chunks, replies: DataFrame, f: Callable[[Chunk, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """Run ``f`` on each chunk and the replies to it; only the replies are shuffled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        return pa.concat_tables([f(c, got) for c in read_chunks(left)])

    return chunks.table.groupBy("chunk_id").cogroup(replies.groupBy("chunk_id")).applyInArrow(run, schema)


# ---------------------------------------------------------------- hashing

MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240613)
#: Two independent hashes: a value for each byte, and an odd base.
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, inverse: bool, seed: int = 0) -> np.ndarray:
    kept = _POWERS.get((seed, inverse))
    if kept is None or len(kept) < n:
        b = pow(_BASES[seed], -1, 1 << 64) if inverse else _BASES[seed]
        kept = np.full(max(n, 1 << 16), b, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        _POWERS[seed, inverse] = kept
    return kept[:n]


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` has the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[seed][data] * _powers(len(data), False, seed), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit content hashes of spans [start, end)."""
    h = (prefix[ends] - prefix[starts]) * _powers(len(prefix), True, seed)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a chunk, split at ASCII white space: spans, hashes, the document of each and its place there."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    counts: np.ndarray


def split_words(c: Chunk, lower: bool = False) -> Words:
    data = c.data
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    hashes = span_hash(prefix_hash(data), starts, ends)
    first = np.searchsorted(starts, c.starts)
    counts = np.diff(np.append(first, len(starts)))
    doc = np.repeat(np.arange(len(c)), counts)
    return Words(starts, ends, hashes, doc, np.arange(len(starts)) - first[doc], counts)


def window_hash(hashes: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """Hashes of every k consecutive items; as many as there are windows, also across documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(multiplier) + hashes[j : j + n]
    return mix(h)


def slices_of(sorted_buckets: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for each bucket that has entries."""
    if len(sorted_buckets):
        at = np.flatnonzero(np.diff(sorted_buckets)) + 1
        for a, b in zip(np.append(0, at), np.append(at, len(sorted_buckets)), strict=True):
            yield int(sorted_buckets[a]), int(a), int(b)


def key_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(p, pa.binary())], ["bucket", "chunk_id", "payload"])


KEY_SCHEMA = "bucket int, chunk_id bigint, payload binary"


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.append(0, np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1)
