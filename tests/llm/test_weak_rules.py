import random
import re

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.weak_rules import fit, rate_documents

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(i, t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[a : a + 3]) for a in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {a + j for a, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_statistics(spark):
    rows = corpus(11, n=80) + [(900, "a b c a b c", "e", "s", 0), (901, "x|y <z> #1\nx|y <z> #1\n\n\n", "e", "s", 0), (902, "w " * 30_000, "e", "s", 0), (None, "p q", None, None, None)]
    got = rate_documents(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "kept")).select(*BASE).collect()
    assert sorted(map(tuple, got), key=lambda x: str(x)) == sorted((brute(i, t) for i, t, *_ in rows), key=lambda x: str(x))


def test_em_finds_the_better_rules():
    r = random.Random(2)
    counts = {}
    recall = (0.9, 0.6, 0.2, 0.7)
    for _ in range(5000):
        good = r.random() < 0.7
        v = tuple(-1 if r.random() < (0.02 if good else q) else r.choice((0, 1)) for q in recall)
        counts[v] = counts.get(v, 0) + 1
    m = fit(sorted(counts.items()), [0.03] * 4)
    assert abs(m.good - 0.7) < 0.05
    assert all(abs(bad[0] - q) < 0.1 for (bad, _), q in zip(m.rates, recall, strict=True))


def test_verdict_and_empty_table(spark):
    r = random.Random(4)
    clean = [" ".join(f"word{r.randrange(900)}" for _ in range(200)) for _ in range(60)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:10]] + [t.upper().replace(" ", "!! ") for t in clean[10:20]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean + junk)]
    got = {x.doc_id: x.kept for x in rate_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(60)) and sum(got[i] for i in range(60, 80)) <= 2
    assert rate_documents(spark.createDataFrame([], SCHEMA)).collect() == []
