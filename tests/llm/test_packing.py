import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.packing import ChunkEncoder, TournamentTree, pack, pack_lengths

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_tree_finds_the_first_bin():
    r = random.Random(5)
    tree, room = TournamentTree(50, 100), [100] * 50
    for _ in range(120):
        size = r.randrange(1, 40)
        first = next((i for i, x in enumerate(room) if x >= size), None)
        if first is None:
            break
        assert tree.first_fit(size) == first
        room[first] -= size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_every_token_once_without_padding(lengths):
    seqs = pack_lengths(lengths, 64)
    seen = defaultdict(list)
    for s in seqs:
        total = sum(n for _, _, n in s)
        assert total == 64 or total & (total - 1) == 0 and total <= 64
        for d, a, n in s:
            assert n > 0
            seen[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(seen[d]):
            assert a == at
            at += k
        assert at == n


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_chunks_encode_as_the_whole_text(text):
    assert ENCODER.encode(text) == np.array(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


ENCODER = ChunkEncoder(PATH)


def test_every_character_alone_and_before_a_symbol():
    """Composition and lower case may leave a mark at the end of a letter, which then belongs to the symbol."""
    import sys
    import unicodedata

    each = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for texts in (each, [c + "." for c in each], ["a" + c + ">" for c in each]):
        want = [np.array(e.ids, "<u4").tobytes() for e in ENCODER.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        got = ENCODER.encode_all(texts)
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_special_tokens_in_any_case_and_long_words():
    for text in ("a <|ENDOFTEXT|> b", "<|EndOfText|>.", "x" * 5000 + ". y", "ÜBER" * 100 + ","):
        assert ENCODER.encode(text) == np.array(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, ENCODER.known)) <= 64


def test_repeated_rows_spread_over_groups(spark):
    rows = [(None, "the same text", "en", "s", 0)] * 400
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(8), PATH, group_docs=16).collect()
    assert sum(r.length for r in got) == 400 * got[0].doc_tokens and len({r.sequence_id >> 32 for r in got}) > 2


def test_pieces_against_the_tokenizer(spark):
    rows = corpus(8, n=40) + [(5000, "long words " * 6000, "en", "s", 0), (5001, "<|endoftext|> a\x1cb", "en", "s", 0), (5001, "<|endoftext|> a\x1cb", "en", "s", 0), (None, "no id", "en", "s", 0)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, group_docs=16).collect()
    whole = {(i, t): np.array([*ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t, *_ in rows}
    by_doc = defaultdict(list)
    by_seq = defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length
    for i, t, *_ in rows:
        if i != 5001:
            pieces = sorted(by_doc[i], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in pieces) == whole[i, t]
            assert all(p.doc_tokens == len(whole[i, t]) // 4 for p in pieces)
    assert sum(p.length for p in by_doc[5001]) == 2 * len(whole[5001, rows[-2][1]]) // 4
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0 and at <= 4096
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_workers_forget_words_when_groups_are_packed(spark):
    rows = [(i, f"word{i} " * 5 + f"other{i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    assert pack(docs, PATH, group_docs=1).count() >= 64

    def remembered(batches):
        import os
        import time

        import pyarrow as pa

        from varispark.llm import packing

        time.sleep(0.2)  # so that every worker gets a task
        list(batches)
        n = sum(len(e.known) + len(e.older) for e in packing._ENCODERS.values())
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(packing._ENCODERS)]), pa.array([n])], ["pid", "encoders", "n"])

    got = spark.range(64, numPartitions=32).mapInArrow(remembered, "pid bigint, encoders bigint, n bigint").collect()
    assert max(r.encoders for r in got) > 0
    assert max(r.n for r in got) == 0
