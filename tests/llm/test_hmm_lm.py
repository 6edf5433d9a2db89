import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import SCHEMA, corpus
from varispark.llm.hmm_lm import Hmm, score_documents


def words(t):
    t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    c = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {str(i): (held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t, *_ in rows for w in [words(t)]}


def test_base_columns(spark):
    rows = corpus(21, n=80) + [(None, "No id Here", None, None, None)]
    got = score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=1).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[str(r.doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.score < 0
    assert score_documents(spark.createDataFrame([], SCHEMA), rounds=1).collect() == []


def test_forward_and_baum_welch_against_enumeration():
    r = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = Hmm(norm(r.random(2)), norm(r.random((2, 2))), norm(r.random((2, 3))))
    seqs = [np.array(s, np.uint16) for s in ([0], [1, 2, 0, 1], [2, 2, 1], [0, 1] * 20)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for s, got in zip(seqs[:3], m.log10_likelihood(seqs), strict=False):
        total = 0.0
        paths = []
        for path in range(2 ** len(s)):
            z = [path >> i & 1 for i in range(len(s))]
            p = m.start[z[0]] * m.emit[z[0], s[0]]
            for i in range(1, len(s)):
                p *= m.move[z[i - 1], z[i]] * m.emit[z[i], s[i]]
            total += p
            paths.append((z, p))
        assert abs(got - math.log10(total)) < 1e-5
        for z, p in paths:
            start[z[0]] += p / total
            for i, x in enumerate(z):
                emit[x, s[i]] += p / total
                if i:
                    move[z[i - 1], x] += p / total
    got = m.expected_counts(iter(seqs[:3]))
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel()]), atol=1e-4)


def test_held_out_text_is_likelier_than_by_unigrams(spark):
    r = random.Random(9)
    languages = [[f"{a}{b}{c}" for a in x for b in "aeiou" for c in y] for x, y in (("bcd", ["tion", "ing"]), ("fgh", ["keit", "ung"]), ("jkl", ["eaux", "ment"]))]
    rows = [(i, " ".join(r.choice(languages[i % 3]) for _ in range(80)), "x", "s", 0) for i in range(300)]
    got = [x for x in score_documents(spark.createDataFrame(rows, SCHEMA), rounds=6, states=4).collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.base_score for x in got) + 0.2 * sum(x.n_tokens for x in got)


def test_score_against_a_plain_version(spark):
    """Words, classes, counts and rounds of training put together in one process give the same scores."""
    import pyarrow as pa

    from varispark.llm.ftrl import text_chunks
    from varispark.llm.hmm_lm import Tokens

    classes, states, rounds = 64, 3, 2
    rows = [x for x in corpus(22, n=60) if x[0] is not None] + [(900, "deep " * 700, "en", "s", 0)]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, SCHEMA).repartition(1), states=states, classes=classes, rounds=rounds).collect()}
    kinds = {}
    for i, t, *_ in rows:
        (c,) = text_chunks(pa.array([(t or "").encode()]))
        kinds[i] = np.asarray(Tokens(c, classes).kinds).astype(np.uint16)
        assert len(kinds[i]) == len(words(t))
    of_word = {w: k for i, t, *_ in rows for w, k in zip(words(t), kinds[i].tolist(), strict=True)}
    count = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    tokens, distinct = np.zeros(classes), np.zeros(classes)
    for w, n in count.items():
        tokens[of_word[w]] += n
        distinct[of_word[w]] += 1
    model = Hmm.initial(tokens, states)
    for _ in range(rounds):
        model = Hmm.from_counts(model.expected_counts(iter([kinds[i] for i, *_ in rows if not held(i)])), tokens, states)
    for i, t, *_ in rows:
        alpha, total = model.start.astype(float), 0.0
        for at, k in enumerate(kinds[i].tolist()):
            alpha = (alpha if not at else alpha @ model.move) * model.emit[:, k]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        total += sum(math.log10((count[w] + 1) / (tokens[of_word[w]] + distinct[of_word[w]] + 1)) for w in words(t) if w is not None)
        assert abs(got[i] - total) < 1e-3 * max(1, abs(total)), (i, got[i], total)


def test_segments_inside_a_text_are_no_starts():
    r = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = Hmm(norm(r.random(2)), norm(r.random((2, 2))), norm(r.random((2, 3))))
    long = r.integers(0, 3, 1000).astype(np.uint16)
    assert abs(m.expected_counts(iter([long]))[:2].sum() - 1) < 1e-4
