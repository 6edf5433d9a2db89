import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.suffix_dedup import dedup_suffixes


def brute(rows, k):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[a : a + k] for _, b in texts for a in range(len(b) - k + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if seen[b[a : a + k]] > 1:
                gone[a : a + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, k):
    out = dedup_suffixes(spark.createDataFrame(rows, SCHEMA).repartition(3), k)
    return sorted(tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def test_against_brute_force(spark):
    for seed, k in ((1, 60), (2, 100), (5, 37), (3, 400)):
        rows = corpus(seed, n=60)
        assert run(spark, rows, k) == brute(rows, k), (seed, k)


def test_ends_of_repeats(spark):
    """Passages of about the length, at random places, in random surroundings over few letters."""
    r = random.Random(7)
    letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
    passages = [letters(n, "abcdefgh") for n in (398, 399, 400, 401, 450, 520, 900)]
    rows = []
    for i in range(60):
        parts = [letters(r.randrange(300), "ab" if i % 2 else "abcdefgh")]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            cut = r.randrange(3) * r.randrange(1, 60)
            parts += [p[cut:], letters(r.randrange(5), "abcdefgh")]
        rows.append((i, "".join(parts), "en", "s", 0))
    assert run(spark, rows, 400) == brute(rows, 400)


def test_runs_copies_and_empty(spark):
    rows = [(1, "a" * 1500, "en", "s", 0), (2, "ab" * 500, "en", "s", 0), (3, "é" * 300, None, None, None), (3, "é" * 300, None, None, None), (None, "", None, None, 0)]
    got = run(spark, [r for r in rows if r[0] is not None], 400)
    assert got == brute([r for r in rows if r[0] is not None], 400)
    assert run(spark, [], 400) == []
    assert dedup_suffixes(spark.createDataFrame(rows, SCHEMA)).count() == 5
