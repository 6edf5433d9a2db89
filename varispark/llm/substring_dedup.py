"""Substring deduplication with fixed-block anchors.

A repeat of ``window`` (13) words holds a whole aligned block of ``block`` (7) words of
any document it lies in, as 13 >= 2 * 7 - 1. So:

1. Every document's non-overlapping blocks are the index; every rolling window of seven
   words probes it. Both travel as packed 32-bit keys, one a distinct key and chunk.
2. A hit is extended word by word while the neighbouring windows are shared too. What is
   shorter than a window is no repeat; each window of a longer run is resolved by its
   own 64-bit key to the smallest document that holds it.
3. A window whose smallest document is smaller than its own is covered; overlapping
   windows merge to maximal repeats, which are removed.

No pairs of documents are formed, so groups of thousands of copies and very common
passages cost one key a chunk. Nothing is capped.

Edge cases: a null or empty text has no words; repeated rows of one id aren't smaller
than each other, so they stay; a null id compares as the largest; texts may be of any
length; an empty table gives an empty result; other columns travel in ``rest``, so none
clashes with those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.chunks import KEY_SCHEMA, Chunk, Chunks, Words, exchange, group_starts, key_batch, pack_chunks, read_chunks, slices_of, split_words, window_hash, with_replies

WINDOW = 13
_BLOCK_MULTIPLIER = 0xC2B2AE3D27D4EB4F
_KEY_MULTIPLIER = 0x165667B19E3779F9
_ROUTE_MULTIPLIER = 0x27D4EB2F165667C5


def block_size(window: int) -> int:
    """The largest block of which any window holds a whole aligned one."""
    return (window + 1) // 2


def _block_keys(w: Words, block: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rolling block: bucket << 30 | 30 bits, and whether it lies in one document."""
    h = window_hash(w.hashes, block, _BLOCK_MULTIPLIER)
    inside = w.doc[: len(h)] == w.doc[block - 1 :] if len(h) else np.zeros(0, bool)
    return (h & np.uint64(n_buckets - 1)) << np.uint64(30) | h >> np.uint64(34), inside


def _probe(c: Chunk, block: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Distinct keys of a chunk, each with two bits: in several documents here, and aligned somewhere."""
    w = split_words(c)
    key, inside = _block_keys(w, block, n_buckets)
    at = np.flatnonzero(inside)
    if not len(at):
        return
    order = at[np.argsort(key[at], kind="stable")]
    k, first = key[order], group_starts(key[order])
    doc = w.doc[order]
    last = np.append(first[1:], len(k)) - 1
    several = doc[first] != doc[last]
    aligned = np.maximum.reduceat((w.place[order] % block == 0).astype(np.uint8), first)
    k = k[first]
    packed = ((k & np.uint64((1 << 30) - 1)) << np.uint64(2)).astype(np.uint32) | several.astype(np.uint32) << np.uint32(1) | aligned.astype(np.uint32)
    for b, i, j in slices_of(k >> np.uint64(30), n_buckets):
        yield b, c.chunk_id, packed[i:j].tobytes()


def _shared(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Which keys occur in two documents or more; the lowest bit: and in the index."""
    parts = [np.frombuffer(p, np.uint32) for p in payloads]
    v = np.concatenate(parts)
    order = np.argsort(v >> np.uint32(2), kind="stable")
    s = v[order]
    first = group_starts(s >> np.uint32(2))
    size = np.diff(np.append(first, len(s)))
    bits = np.bitwise_or.reduceat(s & np.uint32(3), first) if len(s) else s
    shared = (size > 1) | (bits & 2 > 0)
    flag = np.zeros(len(v), np.uint8)
    flag[order] = np.repeat(shared * (2 + (bits & 1)).astype(np.uint8), size)
    at = 0
    for i, p in enumerate(parts):
        f = flag[at : at + len(p)]
        at += len(p)
        hit = f > 0
        yield i, ((p[hit] & ~np.uint32(3)) | (f[hit] & np.uint32(1))).astype(np.uint32).tobytes()


def _candidates(c: Chunk, replies: list[tuple[int, bytes]], window: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Extend hits to whole windows: the distinct window keys of a chunk and the smallest document of each."""
    if not replies:
        return
    block = block_size(window)
    w = split_words(c)
    key, inside = _block_keys(w, block, n_buckets)
    got = [(np.uint64(b) << np.uint64(30) | (v >> np.uint32(2)).astype(np.uint64), v & np.uint32(1)) for b, p in replies for v in [np.frombuffer(p, np.uint32)]]
    known = np.concatenate([k for k, _ in got])
    anchor = np.concatenate([a for _, a in got])
    order = np.argsort(known)
    known, anchor = known[order], anchor[order]
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = (known[at] == key) & inside
    anchored = hit & (anchor[at] > 0)
    n = len(w.hashes) - window + 1
    if n <= 0:
        return
    span = window - block + 1
    run, seen = (np.append(0, np.cumsum(x)) for x in (hit, anchored))
    whole = (run[span:] - run[:-span])[:n] == span
    good = np.flatnonzero(whole & ((seen[span:] - seen[:-span])[:n] > 0) & (w.doc[:n] == w.doc[window - 1 :]))
    if not len(good):
        return
    h, route = _window_keys(w, window, n_buckets)
    h, route, ids = h[good], route[good], c.ids[w.doc[good]]
    order = np.lexsort((ids, h, route))
    h, route, ids = h[order], route[order], ids[order]
    first = np.append(0, np.flatnonzero((h[1:] != h[:-1]) | (route[1:] != route[:-1])) + 1)
    last = np.append(first[1:], len(h)) - 1
    low, high, h, route = ids[first], ids[last], h[first], route[first]
    for b, i, j in slices_of(route, n_buckets):
        yield b, c.chunk_id, h[i:j].tobytes() + low[i:j].tobytes() + np.packbits(high[i:j] != low[i:j]).tobytes()


def _window_keys(w: Words, window: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    route = window_hash(w.hashes, window, _ROUTE_MULTIPLIER) & np.uint64(n_buckets - 1)
    return window_hash(w.hashes, window, _KEY_MULTIPLIER), route


def _smallest(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The smallest document of each window that several documents hold."""
    sizes = [_n_keys(len(p)) for p in payloads]
    h = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes, strict=True)])
    ids = np.concatenate([np.frombuffer(p, np.int64, n, 8 * n) for p, n in zip(payloads, sizes, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=16 * n), count=n) for p, n in zip(payloads, sizes, strict=True)])
    order = np.lexsort((ids, h))
    hs, ds = h[order], ids[order]
    first = group_starts(hs)
    size = np.diff(np.append(first, len(hs)))
    last = first + size - 1
    needed = (ds[first] != ds[last]) | (np.maximum.reduceat(several[order], first) > 0)
    low, need = np.empty_like(ids), np.empty(len(ids), bool)
    low[order], need[order] = np.repeat(ds[first], size), np.repeat(needed, size)
    at = 0
    for i, n in enumerate(sizes):
        keep = need[at : at + n]
        yield i, h[at : at + n][keep].tobytes() + low[at : at + n][keep].tobytes()
        at += n


def _n_keys(size: int) -> int:
    """From bytes to keys: 16 bytes and one bit each."""
    n = size * 8 // 129
    while 16 * n + (n + 7) // 8 < size:
        n += 1
    return n


def _remove(c: Chunk, replies: list[tuple[int, bytes]], window: int, n_buckets: int, keep_layout: bool) -> pa.Table:
    w = split_words(c)
    drop = np.zeros(len(w.hashes) + 1, np.int64)
    n = len(w.hashes) - window + 1
    if replies and n > 0:
        h, route = _window_keys(w, window, n_buckets)
        inside = w.doc[:n] == w.doc[window - 1 :]
        keys = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 16) for _, p in replies])
        low = np.concatenate([np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2) for _, p in replies])
        from_bucket = np.repeat(np.array([b for b, _ in replies], np.uint64), [len(p) // 16 for _, p in replies])
        order = np.argsort(keys, kind="stable")
        keys, low, from_bucket = keys[order], low[order], from_bucket[order]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == h) & (from_bucket[at] == route) & inside & (low[at] < c.ids[w.doc[:n]]))
        np.add.at(drop, hit, 1)
        np.add.at(drop, hit + window, -1)
    gone = np.cumsum(drop)[:-1] > 0
    removed = np.bincount(w.doc[gone], minlength=len(c))
    data = c.data.tobytes()
    first = np.append(0, np.cumsum(w.counts))
    kept = []
    for d in range(len(c)):
        text = data[c.starts[d] : c.ends[d]]
        if removed[d]:
            a, b = first[d], first[d + 1]
            text = b" ".join(data[s:e] for s, e in zip(w.starts[a:b][~gone[a:b]], w.ends[a:b][~gone[a:b]], strict=True))
        elif not keep_layout:
            text = b" ".join(text.split())
        kept.append(text)
    return pa.table({"doc_id": c.id_array, "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "rest": c.rest})


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep_layout: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, and the other columns in ``rest``.

    With ``keep_layout`` a text from which nothing is removed stays as it is; otherwise
    kept words are joined by one space.
    """
    chunks: Chunks = pack_chunks(docs, id_col, text_col)
    nb = chunks.n_buckets
    block = block_size(window)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in read_chunks(b):
                yield key_batch(list(_probe(c, block, nb)))

    hits = exchange(chunks, chunks.table.select("chunk_id", "ids", "texts", "rest").mapInArrow(probes, KEY_SCHEMA), _shared)
    windows = with_replies(chunks, hits, lambda c, r: pa.Table.from_batches([key_batch(list(_candidates(c, r, window, nb)))]), KEY_SCHEMA)
    low = exchange(chunks, windows, _smallest)
    kind = chunks.table.schema["rest"].dataType.elementType.simpleString()
    out = with_replies(chunks, low, lambda c, r: _remove(c, r, window, nb, keep_layout), f"doc_id bigint, n_words bigint, n_removed bigint, kept binary, rest {kind}")
    rest = F.struct(*[F.col("rest")[f"c{i}"].alias(name) for i, name in enumerate(chunks.rest)]) if chunks.rest else F.lit(None)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), rest.alias("rest"))
