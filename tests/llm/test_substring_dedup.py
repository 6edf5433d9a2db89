import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.substring_dedup import dedup_substrings


def brute(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = dedup_substrings(docs)
    return sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect())


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_many_copies_and_repeated_rows(spark):
    base = " ".join(f"t{i}" for i in range(80))
    rows = [(i, base if i % 2 else f"u{i} " + base, "en", "s", 0) for i in range(50)] + [(3, base, "en", "s", 0)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_layout(spark):
    assert run(spark, []) == []
    rows = [(1, "a  b\nc", "en", "s", 6), (None, None, None, None, None)]
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), keep_layout=True).select("doc_id", "kept_text", "rest.*").collect()
    assert {(r.doc_id, r.kept_text, r.lang) for r in got} == {(1, "a  b\nc", "en"), (None, "", None)}
