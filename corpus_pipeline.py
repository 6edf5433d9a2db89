"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of
``documents``. SQL can express none of the stages, so ``ORACLE_SQL`` is None and
tests/llm compares the stages with brute-force versions.

Edge cases: a null text counts as empty; empty texts are kept or rejected by their scores
like any other and are copies of none; of rows of one id near-dedup keeps one, rows
without an id all stay; a long text is one row throughout; of ties the smallest id stays;
an empty table gives an empty result; more columns than those of ``documents`` travel to
the last stage, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.llm.minhash import NearDuplicates
from varispark.llm.packing import pack
from varispark.llm.quality import score_quality, train_quality
from varispark.llm.quality import THRESHOLD as GOOD_FROM
from varispark.llm.substring_dedup import dedup_substrings
from varispark.llm.toxicity import THRESHOLD as TOXIC_FROM
from varispark.llm.toxicity import score_toxicity, train_toxicity, training_labels
from varispark.session import drop_written, materialise, written

TOKENIZER = "word_bpe_49k.json"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = train_toxicity(docs, _labels(spark, sf_dir))
    return docs.where(model.score(docs["text"]) < TOXIC_FROM)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go."""
    model = train_quality(docs, _labels(spark, sf_dir))
    return docs.where(model.score(docs["text"]) >= GOOD_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return NearDuplicates(docs, words=5, percent=80).kept_documents().select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller id are removed; other texts stay as they are."""
    out = dedup_substrings(docs, keep_layout=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("bigint").alias("n_chars")}
    return out.select(*[own.get(c, F.col(f"rest.`{c}`").alias(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote for itself, and its input, go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        drop_written(spark, since=before, keep_last=1)
    return docs
