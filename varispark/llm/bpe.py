"""Byte-level BPE encoding and decoding from published merge ranks.

A pre-token is encoded on a linked list of its parts. Candidate merges wait in a queue
of buckets, one for each merge rank in use, which hold list positions in order; a
hierarchical bitmap over the ranks (words of 64 bits under a word of words) finds the
lowest rank that has entries by find-first-set. A merge makes entries of its neighbours
stale: an entry counts only if the pair at its position still has the rank it was queued
with, and is skipped otherwise. Pre-tokens of many documents share one list and queue. Each of n bytes is merged at most once and queued at most a
constant number of times, so a pre-token of a megabyte takes linear time.

Common pre-tokens are remembered, in bounded memory.

Edge cases: null and empty texts have no ids; special tokens aren't recognised; any text
is covered, as the pattern matches every character; decoding gives the text's bytes; of
equal ranks in a pre-token the leftmost merges first; long texts are encoded whole; repeated
rows and rows without an id are encoded each; an empty table gives an empty result; other
columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.session import ship_package

#: Remembered pre-tokens in each of two generations, none longer than this many characters.
_REMEMBERED, _LONGEST = 400_000, 64
#: Beyond so many remembered pairs, those that don't merge are forgotten.
_PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions in buckets by rank; a hierarchical bitmap finds the lowest rank in use.

    The lower level has a word of 64 bits for 64 ranks, the upper one a bit for each of
    these words; find-first-set is ``(x & -x).bit_length() - 1`` on both.
    """

    __slots__ = ("words", "top", "buckets")

    def __init__(self, ranks: int):
        self.words = [0] * (-(-ranks // 64))
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
        else:
            self.open(rank, [position])

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        at = rank >> 6
        word = self.words[at]
        self.words[at] = word | 1 << (rank & 63)
        if not word:
            self.top |= 1 << at

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions in order, which leave the queue."""
        top = self.top
        if not top:
            return None
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        bit = word & -word
        word ^= bit
        self.words[at] = word
        if not word:
            self.top = top ^ (1 << at)
        rank = at << 6 | (bit.bit_length() - 1)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class BytePairCodec:
    """Encodes and decodes with the ranks and the pre-token pattern of a tokenizer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)])
        self.two_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        #: Two generations of remembered pre-tokens: what is in use moves on to the newer one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.queue = RankQueue(self.size)
        #: left rank << 32 | right rank to the rank of both together, filled as pairs are met
        self.joined: dict[int, int] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, as bytes. All share one list and one queue: a bucket holds the places of a
        rank in every pre-token, and links end where a pre-token ends."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends - sizes] = -1
        first = np.append(self.two_bytes[data[:-1], data[1:]], -1)
        first[ends - 1] = -1
        part, after, before, pair = self.byte_rank[data].tolist(), after.tolist(), before.tolist(), first.tolist()
        queue, joined, pair_rank = self.queue, self.joined.get, self._pair_rank
        push, pop = queue.push, queue.pop
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        for group in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            if len(group):
                queue.open(int(first[group[0]]), group.tolist())
        while (got := pop()) is not None:
            rank, positions = got
            for i in positions:
                if pair[i] != rank:
                    continue  # stale: its parts have changed
                j = after[i]
                part[i], part[j], pair[j] = rank, -1, -1
                k = after[i] = after[j]
                if k < 0:
                    pair[i] = -1
                else:
                    before[k] = i
                    r = joined(rank << 32 | part[k])
                    if r is None:
                        r = pair_rank(rank, part[k])
                    pair[i] = r
                    if r >= 0:
                        push(r, i)
                h = before[i]
                if h >= 0:
                    r = joined(part[h] << 32 | rank)
                    if r is None:
                        r = pair_rank(part[h], rank)
                    pair[h] = r
                    if r >= 0:
                        push(r, h)
        ids = np.array(part, np.int64)
        alive = ids >= 0
        raw = ids[alive].astype("<u4").tobytes()
        cuts = (np.cumsum(alive)[ends - 1] * 4).tolist()
        return [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _pair_rank(self, a: int, b: int) -> int:
        """The rank of both together, or -1; remembered."""
        r = self.joined[a << 32 | b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` for many texts; their new pre-tokens are merged together."""
        split = [self.split(t) for t in texts]
        missing = {p for pieces in split for p in pieces if p not in self.known}
        if missing:
            if len(self.known) + len(missing) > _REMEMBERED:
                self.older, self.known = self.known, {}
                missing = {p for pieces in split for p in pieces}
                if len(self.joined) > _PAIRS:
                    self.joined = {k: r for k, r in self.joined.items() if r >= 0}
            self._learn(missing)
        get = self.known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        for p in missing:
            if len(p) > _LONGEST:
                del self.known[p]
        return out

    def _learn(self, missing: set[str]) -> None:
        known, older, ranks = self.known, self.older.get, self.ranks.get
        names, pieces = [], []
        for p in missing:
            ids = older(p)
            if ids is None:
                raw = p.encode("utf-8", "replace")
                rank = ranks(raw)
                if rank is None:
                    names.append(p)
                    pieces.append(raw)
                    continue
                ids = rank.to_bytes(4, "little")
            known[p] = ids
        if pieces:
            known.update(zip(names, self.merge(pieces), strict=True))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (unsigned 32-bit integers, little-endian)."""
    return _run(docs, ranks_path, pattern, id_col, text_col, lambda c, ids: (ids,), "ids binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and keep doc_id, n_tokens and the digests of both."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _run(docs, ranks_path, pattern, id_col, text_col, lambda c, ids: (len(ids) // 4, sha(ids), sha(c.decode(ids))), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, f, schema: str) -> DataFrame:
    ship_package(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [f(c, ids) for ids in c.encode_all([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, {schema}")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of ``encode_documents``' rows; null ids decode to nothing."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", F.col("ids").alias("ids")).mapInArrow(run, "doc_id bigint, decoded binary")
