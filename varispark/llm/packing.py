"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised and dealt to randomised groups by a hash of their content and
their input partition; each group is packed on its own, so packing scales with the number
of groups. Groups are counted by documents and by bytes, so a group's memory follows
neither; rows of one id and text spread as they do over the input. In a group:

1. Documents of ``capacity`` tokens or more are cut into full sequences.
2. What remains is placed by first-fit decreasing. A tournament tree holds the free room
   of every bin, each inner node that of its roomiest child, so the first bin that fits
   is found in log(bins) steps.
3. Rest room is used up: pieces of the emptiest bins are cut to fill the others, and the
   tokens left over at the end form sequences whose lengths are powers of two, which
   need no padding.

Tokens come from a public tokenizer file; every white-space separated chunk of a text is
encoded once and remembered, as this tokenizer's normaliser and splitter never look
across white space; the number and the length of what is remembered are bounded, and it
is dropped when the groups are packed.

Edge cases: a null or empty text has the end token alone; a null id stays null; repeated
rows are packed as separate documents; an empty table gives no pieces; texts that hold
the start of a special token are encoded whole, so the library decides; a long text, or a
long word, is encoded whole and cut by tokens only; ties in length go by id and content;
of other columns none is read, whatever they are called.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.session import release_memory, ship_package, shuffle_partitions

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads here

CAPACITY = 4096
END_ID = 2
#: Documents of a group, and bytes of its texts, about: whichever makes more groups.
GROUP_DOCS = 512
GROUP_BYTES = 2 << 20
#: Remembered chunks of text in each of two generations; the memory of a worker is bounded by it.
_REMEMBERED = 700_000
#: Characters of a remembered chunk, at most.
_LONGEST = 64
#: Characters whose lower case or composition could depend on the Unicode version.
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Symbols that end a word and form one pre-token by themselves.
_SYMBOLS = ".,;:!?#$%&*|<>()[]{}=+-_/\\\"~^@`"


class ChunkEncoder:
    """Encodes texts with a tokenizer that never merges across white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For words of letters in lower case that composition leaves alone: split at spaces, and encode.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Starts of special tokens in either case, and separators that only Python takes for white space.
        self.special = [*{t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}, *"\x1c\x1d\x1e\x1f"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Two generations of remembered chunks: what is in use moves on to the newer one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` for many texts; what they have that is new is encoded together."""
        out: list[bytes] = [b""] * len(texts)
        waiting = []
        missing: set[str] = set()
        get = self.known.get
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[k] = _ids_bytes(self.tokenizer.encode(t, add_special_tokens=False).ids)
                continue
            # lower case as the normaliser does, so more chunks are alike
            chunks = (t.lower() if t.isascii() or not _BEYOND.search(t) else t).split()
            ids = list(map(get, chunks))
            holes = [i for i, x in enumerate(ids) if x is None]
            if holes:
                missing.update([chunks[i] for i in holes])
                waiting.append((k, chunks, ids, holes))
            else:
                out[k] = b"".join(ids)
        if missing:
            fresh = self._learn(missing)
            for k, chunks, ids, holes in waiting:
                for i in holes:
                    ids[i] = fresh[chunks[i]]
                out[k] = b"".join(ids)
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the newer generation lacks, remembered but for long ones.

        Letters and the symbols after them are separate pre-tokens, encoded apart. That
        is done only for letters which lower case and composition leave letters.
        """
        if len(self.known) + len(missing) > _REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found: dict[str, bytes] = {}
        split: list[tuple[str, str, str]] = []
        fresh: set[str] = set()
        for c in missing:
            ids = older.get(c)
            if ids is not None:
                found[c] = ids
                continue
            word = c.rstrip(_SYMBOLS)
            if word != c and word.isalpha() and (word.isascii() or not _BEYOND.search(word)):
                tail = c[len(word) :]
                split.append((c, word, tail))
                for x in (word, tail):
                    if x not in found:
                        ids = known.get(x) or older.get(x)
                        if ids is None:
                            fresh.add(x)
                        else:
                            found[x] = ids
            else:
                fresh.add(c)
        words = [x for x in fresh if x.isalpha() and (x.isascii() or not _BEYOND.search(x))]
        if words and not self._learn_words(words, found):
            words = []
        rest = list(fresh.difference(words))
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[c] = _ids_bytes(e.ids)
        for c, word, tail in split:
            found[c] = found[word] + found[tail]
        known.update(found if max(map(len, found)) <= _LONGEST else {c: x for c, x in found.items() if len(c) <= _LONGEST})
        return found

    def _learn_words(self, words: list[str], found: dict[str, bytes]) -> bool:
        """Encode words of letters in one go: each is one pre-token, and the last token of each ends a word."""
        (e,) = self.of_words.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(words):
            return False
        raw, at = ids.tobytes(), 0
        for w, to in zip(words, ends.tolist(), strict=True):
            found[w] = raw[at:to]
            at = to
        return True


def _ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget_chunks() -> None:
    """Drop what this worker's encoders remember, if anything: workers live on after the stage that tokenises."""
    used = [e for e in _ENCODERS.values() if e.known or e.older]
    for e in used:
        e.known, e.older = {}, {}
    if used:
        release_memory()


@contextlib.contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the search for cycles, which code that makes many plain lists and none of those pays for in vain."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class TournamentTree:
    """Free room of bins; finds the first bin with room for an item."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin that has it, and tell which."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token of each document once.

    All sequences are full or have a power of two of tokens.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        out.extend([(d, s, capacity)] for s in range(0, whole, capacity))
        if n > whole:
            rest.append((d, whole, n - whole))
    rest.sort(key=lambda x: (-x[2], x[0]))
    tree = TournamentTree(len(rest), capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rest]
    for item in rest:
        bins[tree.first_fit(item[2])].append(item)
    bins = [b for b in bins if b]
    used = [sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-used[i], i))
    # pieces of the emptiest bins fill the room that the fullest have left
    low, high = 0, len(order) - 1
    while low < high:
        to, source = order[low], order[high]
        gap = capacity - used[to]
        if not gap:
            low += 1
        elif not bins[source]:
            high -= 1
        else:
            d, s, n = bins[source].pop()
            take = min(n, gap)
            bins[to].append((d, s, take))
            used[to] += take
            used[source] -= take
            if take < n:
                bins[source].append((d, s + take, n - take))
    for i in order:
        if used[i] == capacity:
            out.append(bins[i])
        elif used[i]:
            out.extend(_powers_of_two(bins[i], used[i]))
    return out


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    pieces = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        left, seq = (1 << bit) & total, []
        while left:
            d, s, n = pieces.pop()
            take = min(n, left)
            seq.append((d, s, take))
            left -= take
            if take < n:
                pieces.append((d, s + take, n - take))
        if seq:
            yield seq


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit integers, little-endian), each with ``end_id`` at its end."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                with _no_cycles():
                    ids = [x + end for x in e.encode_all([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: where it starts there, and its sequence and offset.

    ``sequence_id`` is group << 32 | number in the group.
    """
    spark = docs.sparkSession
    n_docs, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length(docs["text"].cast("string")))).first()
    groups = max(1, -(-n_docs // group_docs), -(-(n_bytes or 0) // GROUP_BYTES))
    rows = tokenize(docs, tokenizer_path, end_id)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "ids", F.spark_partition_id()), F.lit(groups)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        forget_chunks()  # every text is encoded by now
        order = t.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        doc_ids, ids = order.column("doc_id").to_pylist(), order.column("ids").to_pylist()
        sizes = [len(x) // 4 for x in ids]
        base, out = key[0].as_py() << 32, []
        with _no_cycles():
            for number, seq in enumerate(pack_lengths(sizes, capacity)):
                offset = 0
                for d, s, n in seq:
                    piece = ids[d][4 * s : 4 * (s + n)]
                    out.append((doc_ids[d], s, n, zlib.crc32(piece), sizes[d], base | number, offset, piece if with_ids else None))
                    offset += n
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
        return pa.table({name: pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip([x.split()[0] for x in PIECES.split(", ")], cols, strict=True)})

    return rows.repartition(min(groups, 8 * shuffle_partitions(spark)), "grp").groupBy("grp").applyInArrow(run, PIECES)
