"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits in lower case, whatever symbols stand around them.
Features are the presence of single words, of their stems (the first bytes of longer
words, which inflected forms share), of pairs, and of pairs with a word between them.
Weights are sparse by L1, so the many neutral words of a long document add nothing to its
score.

Edge cases: null and empty texts get the intercept's probability; long texts are scored
whole; documents without labels, and labels without documents, aren't used in training; repeated rows
are scored alike, and each counts in training; of several labels of an id the largest counts; an
empty table of documents or labels gives an empty result or the probability one half; columns
of ``docs`` named score or predicted are kept as score_input and predicted_input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.chunks import Chunk
from varispark.llm.ftrl import FtrlModel, FtrlParams, held_out, ngrams, skipgrams, stems, tokens, train, with_scores

PARAMS = FtrlParams(bits=20, alpha=1.0, beta=1.0, l1=3.0, l2=0.0, epochs=2, max_rows=10_000)
THRESHOLD = 0.5


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    t = tokens(c, symbols=False)
    parts = [ngrams(t, 1, 0x8CB92BA72F3D8DD7), ngrams(t, 2, 0xC6BC279692B5C323), skipgrams(t, 1, 0x9E6C63D0676A9A99), stems(t, 4, 0xD1B54A32D192ED03), stems(t, 5, 0xD1B54A32D192ED03)]
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])


def train_toxicity(docs: DataFrame, labels: DataFrame, params: FtrlParams = PARAMS) -> FtrlModel:
    """Fit on ``labels.toxic``; ``labels`` holds the rows to learn from."""
    return train(docs, labels, "toxic", features, params)


def score_toxicity(docs: DataFrame, model: FtrlModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (probability of being toxic) and predicted."""
    return with_scores(docs, model, threshold)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows outside the held-out fold."""
    return labels.where(~held_out(F.col("doc_id")))
