"""Repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every document into phrases: the trigger of a ``length``-byte
string is the position with the smallest rolling hash among the string's first ``span``
positions (the last of equals), so equal strings have their trigger at the same offset
and every string has one. All strings with one trigger form its *context*: a piece of
the phrase before it (the dictionary side) and what follows it (a suffix of the parse).

1. Parse. Each trigger has a digest of the parse suffix after it, as deep as all its
   strings reach, and of its whole context. Distinct digests of each chunk meet in hash
   buckets: a parse suffix that occurs once has no repeats; a context that occurs twice
   is repeated as a whole.
2. Only where different contexts share a parse suffix (at the two ends of a repeat)
   single strings are compared. There the suffix array of the dictionary (all suffixes
   of the phrase pieces) and of the parse (what follows the triggers) are built for
   each chunk and combined into its order: by phrase suffix, then by rank of the parse
   suffix. Neighbours in that order whose common prefix reaches ``length`` are equal;
   every class of equals travels once, as a digest, to the classes of other chunks.
3. Strings that occur twice or more anywhere are removed, with all their copies.

Highly repetitive text is cheap: a context costs one key a chunk however often it
occurs. Nothing is capped, and no group of copies meets in one task.

Edge cases: null texts are empty; strings never cross documents; repeated rows are
separate documents, hence copies; removing may split a UTF-8 character, so the kept
bytes are binary; a long text is a chunk of its own; a null id stays null; an empty table
gives an empty result; other columns travel in ``rest``, so none clashes with those of the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.chunks import KEY_SCHEMA, Chunk, exchange, group_starts, key_batch, pack_chunks, prefix_hash, read_chunks, slices_of, span_hash, with_replies
from varispark.session import materialise

LENGTH = 400
#: Rolling-hash width; the number of positions of which one is the trigger is a power of two.
_WIDTH = 16
_POSITION_BITS = 30


def trigger_span(length: int) -> int:
    """The largest power of two below a third of ``length``."""
    return 1 << ((length // 3).bit_length() - 1)


class Parse:
    """Triggers of a chunk: each with the first and last start of its strings."""

    def __init__(self, c: Chunk, length: int):
        span = trigger_span(length)
        width = min(_WIDTH, length - span)
        self.length, self.data = length, c.data
        n = len(c.data)
        sizes = np.maximum(0, c.ends - c.starts - length + 1)
        total = int(sizes.sum())
        self.prefix = prefix_hash(c.data)
        if not total:
            self.lo = self.hi = self.at = np.zeros(0, np.int64)
            return
        before = np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
        a = np.repeat(c.starts, sizes) + (np.arange(total) - before)
        p = np.arange(n - width + 1)
        low = (1 << _POSITION_BITS) - 1
        m = span_hash(self.prefix, p, p + width) & ~np.uint64(low) | (low - p).astype(np.uint64)
        step = 1
        while step < span:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        at = low - (m[a] & np.uint64(low)).astype(np.int64)
        first = np.append(0, np.flatnonzero((at[1:] != at[:-1]) | (a[1:] != a[:-1] + 1)) + 1)
        last = np.append(first[1:], total) - 1
        self.lo, self.hi, self.at = a[first], a[last], at[first]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the parse suffix after each trigger, and of its context."""
        deep = self.length - trigger_span(self.length) + 1
        return span_hash(self.prefix, self.at, self.at + deep), span_hash(self.prefix, self.lo, self.hi + self.length)


def _contexts(c: Chunk, length: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    suffix, context = Parse(c, length).digests()
    if not len(suffix):
        return
    bucket = suffix & np.uint64(n_buckets - 1)
    order = np.lexsort((context, suffix, bucket))
    s, x, b = suffix[order], context[order], bucket[order]
    first = np.append(0, np.flatnonzero((s[1:] != s[:-1]) | (x[1:] != x[:-1])) + 1)
    several = (np.diff(np.append(first, len(s))) > 1).astype(np.uint8)
    s, x = s[first], x[first]
    for k, i, j in slices_of(b[first], n_buckets):
        yield k, c.chunk_id, s[i:j].tobytes() + x[i:j].tobytes() + several[i:j].tobytes()


def _match_contexts(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Reply with bit 1: the context is repeated as a whole; bit 2: compare its strings."""
    sizes = [len(p) // 17 for p in payloads]
    s = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes, strict=True)])
    x = np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n) for p, n in zip(payloads, sizes, strict=True)])
    several = np.concatenate([np.frombuffer(p, np.uint8, n, 16 * n) for p, n in zip(payloads, sizes, strict=True)])
    order = np.lexsort((x, s))
    so, xo = s[order], x[order]
    new_group = np.append(True, so[1:] != so[:-1])
    new = new_group | np.append(True, xo[1:] != xo[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(so)))
    full = (size > 1) | (np.maximum.reduceat(several[order], first) > 0)
    group = np.cumsum(new_group[first]) - 1
    mixed = (np.bincount(group) > 1)[group]
    flags = np.zeros(len(so), np.uint8)
    flags[order] = np.repeat(full.astype(np.uint8), size)
    ask = np.repeat(mixed & ~full, size)
    ask[first] |= mixed  # of a repeated context one chunk speaks for all
    flags[order] |= ask.astype(np.uint8) * 2
    at = 0
    for i, n in enumerate(sizes):
        f = flags[at : at + n]
        keep = f > 0
        yield i, x[at : at + n][keep].tobytes() + f[keep].tobytes()
        at += n


def _flags(parse: Parse, replies: list[tuple[int, bytes]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The reply to each trigger, and the digest of its context."""
    suffix, context = parse.digests()
    out = np.zeros(len(context), np.uint8)
    if len(context) and replies:
        sizes = [len(p) // 9 for _, p in replies]
        x = np.concatenate([np.frombuffer(p, np.uint64, n) for (_, p), n in zip(replies, sizes, strict=True)])
        f = np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n) for (_, p), n in zip(replies, sizes, strict=True)])
        b = np.repeat(np.array([b for b, _ in replies], np.uint64), sizes)
        order = np.argsort(x)
        x, f, b = x[order], f[order], b[order]
        at = np.minimum(np.searchsorted(x, context), len(x) - 1)
        hit = (x[at] == context) & (b[at] == suffix & np.uint64(n_buckets - 1))
        out[hit] = f[at[hit]]
    return out, context


def combined_order(data: bytes, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of the given triggers in corpus order: start, index of the trigger, class of equals.

    The order combines two suffix arrays: of the dictionary (suffixes of the phrase
    pieces before the triggers) and of the parse (what follows each trigger).
    """
    k = len(at)
    after = [data[j : h + length] for j, h in zip(at.tolist(), hi.tolist(), strict=True)]
    parse_sa = sorted(range(k), key=after.__getitem__)
    rank = np.empty(k, np.int64)
    rank[parse_sa] = np.arange(k)
    common = np.array([0, *(_common_prefix(after[i], after[j]) for i, j in zip(parse_sa, parse_sa[1:], strict=False))], np.int64)
    table = [common]
    while 2 << (len(table) - 1) <= k:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    sizes = hi - lo + 1
    owner = np.repeat(np.arange(k), sizes)
    start = np.repeat(lo, sizes) + np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
    pieces = [data[a:j] for a, j in zip(start.tolist(), at[owner].tolist(), strict=True)]
    place = {p: i for i, p in enumerate(sorted(set(pieces)))}
    phrase_suffix = np.fromiter((place[p] for p in pieces), np.int64, len(pieces))
    order = np.lexsort((rank[owner], phrase_suffix))
    start, owner, phrase_suffix = start[order], owner[order], phrase_suffix[order]
    r = rank[owner]
    new = np.ones(len(order), bool)
    same = np.flatnonzero(phrase_suffix[1:] == phrase_suffix[:-1])
    if len(same):
        a, b = r[same], r[same + 1]  # the common prefix is the least one between the two ranks
        reach = np.full(len(same), np.iinfo(np.int64).max)
        apart = np.flatnonzero(b > a)
        level = np.log2(np.maximum(1, (b - a)[apart])).astype(np.int64)
        for v in np.unique(level):
            on = apart[level == v]
            reach[on] = np.minimum(table[v][a[on] + 1], table[v][b[on] - (1 << v) + 1])
        new[same + 1] = reach < length - (at[owner[same]] - start[same])
    return start, owner, np.cumsum(new) - 1


def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def _string_keys(parse: Parse, other: np.ndarray, starts: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return span_hash(parse.prefix, starts, starts + parse.length), span_hash(other, starts, starts + parse.length, 1) & np.uint64(n_buckets - 1)


def _classes(c: Chunk, replies: list[tuple[int, bytes]], length: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Classes of equal strings at the ends of repeats; with one bit: occurs twice or more."""
    if not replies:
        return
    parse = Parse(c, length)
    flags, context = _flags(parse, replies, n_buckets)
    on = np.flatnonzero(flags & 2)
    if not len(on):
        return
    _, once = np.unique(context[on], return_index=True)
    on = on[once]
    start, owner, group = combined_order(c.data.tobytes(), parse.lo[on], parse.hi[on], parse.at[on], length)
    first = group_starts(group)
    whole = (flags[on] & 1)[owner]
    several = (np.diff(np.append(first, len(group))) > 1) | (np.maximum.reduceat(whole, first) > 0)
    key, route = _string_keys(parse, prefix_hash(c.data, 1), start[first], n_buckets)
    order = np.lexsort((key, route))
    key, route, several = key[order], route[order], several[order].astype(np.uint8)
    for b, i, j in slices_of(route, n_buckets):
        yield b, c.chunk_id, key[i:j].tobytes() + several[i:j].tobytes()


def _match_classes(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    sizes = [len(p) // 9 for p in payloads]
    key = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes, strict=True)])
    several = np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n) for p, n in zip(payloads, sizes, strict=True)])
    order = np.argsort(key, kind="stable")
    first = group_starts(key[order])
    size = np.diff(np.append(first, len(key)))
    repeated = np.zeros(len(key), bool)
    repeated[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], first) > 0), size)
    at = 0
    for i, n in enumerate(sizes):
        yield i, key[at : at + n][repeated[at : at + n]].tobytes()
        at += n


def _remove(c: Chunk, replies: list[tuple[int, bytes]], length: int, n_buckets: int) -> pa.Table:
    cover = np.zeros(len(c.data) + 1, np.int64)
    if replies:
        parse = Parse(c, length)
        flags, _ = _flags(parse, [(b, p) for b, p in replies if b >= 0], n_buckets)
        full = flags & 1 > 0
        np.add.at(cover, parse.lo[full], 1)
        np.add.at(cover, parse.hi[full] + length, -1)
        on = np.flatnonzero(flags == 2)
        got = [(-1 - b, p) for b, p in replies if b < 0]
        if len(on) and got:
            sizes = (parse.hi - parse.lo)[on] + 1
            start = np.repeat(parse.lo[on], sizes) + np.arange(sizes.sum()) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
            key, route = _string_keys(parse, prefix_hash(c.data, 1), start, n_buckets)
            known = np.concatenate([np.frombuffer(p, np.uint64) for _, p in got])
            bucket = np.repeat(np.array([b for b, _ in got], np.uint64), [len(p) // 8 for _, p in got])
            order = np.argsort(known)
            known, bucket = known[order], bucket[order]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = start[(known[at] == key) & (bucket[at] == route)]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
    gone = np.cumsum(cover)[:-1] > 0
    edge = gone & ~np.append(False, gone[:-1])
    gone_before, edges_before = (np.append(0, np.cumsum(x)) for x in (gone, edge))
    removed = gone_before[c.ends] - gone_before[c.starts]
    # a run never crosses the separator between documents, as no string does
    spans = edges_before[c.ends] - edges_before[c.starts]
    data = c.data.tobytes()
    kept = [data[a:b] if not r else c.data[a:b][~gone[a:b]].tobytes() for a, b, r in zip(c.starts.tolist(), c.ends.tolist(), removed.tolist(), strict=True)]
    return pa.table({"doc_id": c.id_array, "n_bytes": pa.array(c.ends - c.starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "rest": c.rest})


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary), and the other columns in ``rest``."""
    chunks = pack_chunks(docs, id_col, text_col)
    nb = chunks.n_buckets

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in read_chunks(b):
                yield key_batch(list(_contexts(c, length, nb)))

    by_context = materialise(exchange(chunks, chunks.table.mapInArrow(contexts, KEY_SCHEMA), _match_contexts))
    strings = with_replies(chunks, by_context, lambda c, r: pa.Table.from_batches([key_batch(list(_classes(c, r, length, nb)))]), KEY_SCHEMA)
    by_class = exchange(chunks, strings, _match_classes).withColumn("bucket", -1 - F.col("bucket"))
    kind = chunks.table.schema["rest"].dataType.elementType.simpleString()
    out = with_replies(chunks, by_context.unionByName(by_class), lambda c, r: _remove(c, r, length, nb), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, rest {kind}")
    rest = F.struct(*[F.col("rest")[f"c{i}"].alias(name) for i, name in enumerate(chunks.rest)]) if chunks.rest else F.lit(None)
    return out.withColumn("rest", rest)
