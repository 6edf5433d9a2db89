import re

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.minhash import NearDuplicates, near_duplicates


def shingles(t, k):
    t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k=2):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def run(spark, rows, k=2):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k)
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())


def test_against_brute_force(spark):
    for seed, k in ((1, 2), (4, 5)):
        rows = corpus(seed, n=90, vocab=300)
        rows += [(1000, "One Word", "en", "s", 0), (1001, "one word", "en", "s", 0), (1002, "ONE", "en", "s", 0), (1003, "one", "en", "s", 0)]
        assert run(spark, rows, k) == brute(rows, k)


def test_chain_of_near_copies(spark):
    """Neighbours are linked, the ends aren't: components need links that no single centre has."""
    words = [f"w{i}" for i in range(400)]
    rows = [(j, " ".join(words[7 * j : 7 * j + 120]), "en", "s", 0) for j in range(30)]
    assert run(spark, rows) == brute(rows)


def test_kept_documents_and_odd_rows(spark):
    rows = [(5, "a b c d e f", "en", "x", 1), (5, "a b c d e f", "en", "y", 1), (7, "A b c d e f", "en", "z", 2), (None, "a b c d e f", None, None, None), (8, None, "en", "q", 0), (9, "", "en", "q", 0)]
    kept = NearDuplicates(spark.createDataFrame(rows, SCHEMA)).kept_documents()
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 5), (False, 8), (False, 9), (True, 0)]
    assert run(spark, []) == []


def test_many_documents_just_below_the_threshold(spark):
    """1,000 edited copies of one text that share bands but no link, and some that do: exact, without all pairs."""
    import random

    from varispark.llm import minhash as M

    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]

    def edited(n, tag):
        words = list(base)
        for at in r.sample(range(1, 119), n):
            words[at] = f"{tag}x{at}"
        return " ".join(words)

    # each replaced word breaks two pairs: 14 of them leave 0.62 among copies, and 0.77 with the base
    rows = [(i, edited(14, f"d{i}"), "en", "s", 0) for i in range(1000)]
    rows += [(5000, " ".join(base), "en", "s", 0), (5001, edited(3, "e"), "en", "s", 0), (5002, edited(12, "f"), "en", "s", 0)]
    sizes = []
    plain = M._confirm

    def counted(edges, *args):
        edges = edges.cache()
        sizes.append(edges.count())
        return plain(edges, *args)

    M._confirm = counted
    try:
        got = run(spark, rows)
    finally:
        M._confirm = plain
    assert got == brute(rows)
    assert max(sizes) < 32 * len(rows) and sizes[-1] < len(rows) / 10


def test_connected_components(spark):
    import random

    from varispark.llm.components import connected_components

    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, x) for x in range(201, 230)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    ends = {x for a, b in edges if a != b for x in (a, b)}
    got = sorted(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == sorted((x, root(x)) for x in ends)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
