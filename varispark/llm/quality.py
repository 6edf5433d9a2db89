"""Quality classifier: hashed word n-gram logistic regression, trained by follow the regularised leader.

Tokens are runs of letters and digits in lower case and runs of symbols; features are
the presence of n-grams of one to three tokens, and a few document-level n-grams over
abstract tokens: the share of repeated words, of symbols, and of capitals in classes.
Scores are sparse dot products.

Edge cases: null and empty texts get the probability of a document without any word;
long texts are scored whole; repeated rows
are scored alike, and each counts in training; of several labels of an id the largest counts; an
empty table of documents or labels gives an empty result or the probability one half; columns
of ``docs`` named score or predicted are kept as score_input and predicted_input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from varispark.llm.chunks import Chunk, mix
from varispark.llm.ftrl import FtrlModel, FtrlParams, ngrams, tokens, train, with_scores

PARAMS = FtrlParams(bits=20, alpha=0.5, beta=1.0, l1=2.0, l2=0.0, epochs=2, max_rows=10_000)
THRESHOLD = 0.3


def _shares(c: Chunk, t) -> tuple[np.ndarray, np.ndarray]:
    """Abstract tokens: each share of a document, in sixteenths, is a word of its own."""
    n = len(c)
    size = np.maximum(1, np.bincount(t.doc, minlength=n))
    word = t.is_word
    again = np.zeros(len(t.doc), bool)
    for back in (1, 2):
        if len(t.doc) > back:
            again[back:] |= (t.hashes[back:] == t.hashes[:-back]) & (t.doc[back:] == t.doc[:-back]) & word[back:]
    upper = (c.data >= 65) & (c.data <= 90)
    lower = (c.data >= 97) & (c.data <= 122)
    ups, lows = (np.append(0, np.cumsum(x)) for x in (upper, lower))
    u, low = ups[c.ends] - ups[c.starts], lows[c.ends] - lows[c.starts]
    pair = np.unique(np.stack([t.doc.astype(np.uint64), t.hashes]), axis=1) if len(t.doc) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pair[0].astype(np.int64), minlength=n)
    shares = [
        np.bincount(t.doc[again], minlength=n) / size,
        np.bincount(t.doc[~word], minlength=n) / size,
        u / np.maximum(1, u + low),
        distinct / size,
        np.minimum(1, np.log2(size) / 16),
    ]
    docs, out = [], []
    for i, s in enumerate(shares):
        level = np.minimum(16, np.ceil(s * 16)).astype(np.uint64)
        docs.append(np.arange(n))
        out.append(mix(level * np.uint64(0xA24BAED4963EE407) + np.uint64(i + 1)))
    return np.concatenate(docs), np.concatenate(out)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    t = tokens(c, symbols=True)
    parts = [ngrams(t, 1, 0xE7037ED1A0B428DB), ngrams(t, 2, 0x8EBC6AF09C88C6E3), ngrams(t, 3, 0x589965CC75374CC3), _shares(c, t)]
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])


def train_quality(docs: DataFrame, labels: DataFrame, params: FtrlParams = PARAMS) -> FtrlModel:
    """Fit on ``labels.quality``; ``labels`` holds the rows to learn from."""
    return train(docs, labels, "quality", features, params)


def score_quality(docs: DataFrame, model: FtrlModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted."""
    return with_scores(docs, model, threshold)
