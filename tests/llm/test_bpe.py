import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.bpe import BytePairCodec, RankQueue, decode_documents, digest_documents, encode_documents, load_ranks

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(PATH)
CODEC = BytePairCodec(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_queue_gives_ranks_in_order():
    q = RankQueue(300_000)
    for r, i in ((5, 1), (299_999, 2), (5, 0), (64, 9), (4096, 3), (5, 7)):
        q.push(r, i)
    assert [q.pop() for _ in range(5)] == [(5, [0, 1, 7]), (64, [9]), (4096, [3]), (299_999, [2]), None]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab", max_size=80), st.text(alphabet="the in g\n", max_size=80)))
def test_like_the_library(text):
    assert CODEC.encode(text) == np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_very_long_pre_tokens():
    for text in ("a" * 200_000, "abc" * 30_000, " " * 5000, "日本語" * 9000):
        ids = CODEC.encode(text)
        assert CODEC.decode(ids) == text.encode()
    for text in ("a" * 3000, "abcab" * 500, "日本語" * 300):
        assert CODEC.encode(text) == np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()


def test_documents(spark):
    rows = corpus(3, n=30) + [(None, "<|endoftext|>", "en", "s", 0), (4, "twice", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows for ids in [LIBRARY.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest_documents(docs, PATH, P.PATTERN).collect()) == want
    back = decode_documents(encode_documents(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(i), (t or "").encode()) for i, t, *_ in rows)
    assert digest_documents(docs.limit(0), PATH, P.PATTERN).collect() == []
