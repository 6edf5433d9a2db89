"""Every operator over documents takes nulls, empty, long and repeated texts, and columns named like its own."""

import pytest
from pyspark.sql import functions as F

from varispark.llm.hmm_lm import score_documents
from varispark.llm.minhash import NearDuplicates, near_duplicates
from varispark.llm.substring_dedup import dedup_substrings
from varispark.llm.suffix_dedup import dedup_suffixes
from varispark.llm.weak_rules import rate_documents

TOKENIZERS = pytest.importorskip("public_tokenizers")
CLASHING = ("chunk_id", "place", "bucket", "payload", "id", "ids", "texts", "rest", "kept", "n_words", "n_removed", "score", "component_id", "list", "grp", "n_tokens", "classes", "posterior", "held_out", "bands", "c0")
LONG = "some words that make a long text of many lines and more\n" * 60_000
ROWS = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (4, LONG), (None, "no id")]


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return docs.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def bpe(docs):
    from varispark.llm.bpe import digest_documents

    return digest_documents(docs, TOKENIZERS.path("byte_bpe_multi_50k.tiktoken"), TOKENIZERS.PATTERN)


def packed(docs):
    from varispark.llm.packing import pack

    return pack(docs, TOKENIZERS.path("word_bpe_49k.json")).where("start = 0")


OPERATORS = {"bpe": bpe, "packing": packed, "substrings": dedup_substrings, "suffixes": lambda d: dedup_suffixes(d, length=40), "near": near_duplicates, "kept": lambda d: NearDuplicates(d).kept_documents(), "rules": rate_documents, "hmm": lambda d: score_documents(d, rounds=1)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    once = [(False, 1), (False, 2), (False, 3), (False, 3), (False, 4), (True, 0)]
    assert ids == ([x for i, x in enumerate(once) if i != 3] if name == "kept" else once)
    if name == "kept":
        assert all(r[c] == f"own {c}" for r in got for c in CLASHING)
    if name in ("substrings", "suffixes"):
        assert all(r["rest"][c] == f"own {c}" for r in got for c in CLASHING)
    assert OPERATORS[name](table(spark, [])).collect() == []
