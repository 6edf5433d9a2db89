import random
import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA
from varispark.llm import quality, toxicity
from varispark.llm.ftrl import held_out


def rows(n, seed=3):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(20, 200))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vile", "rotten", "vilely"]))
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(4)]
        out.append((i, " ".join(words), int(good), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    data = rows(1200)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in data], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data], "doc_id bigint, quality int, toxic int")
    fold = toxicity.training_labels(labels)
    test = {i for i, *_ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in labels.where(held_out(F.col("doc_id"))).collect()} == test
    for module, train, score, column in ((toxicity, toxicity.train_toxicity, toxicity.score_toxicity, 3), (quality, quality.train_quality, quality.score_quality, 2)):
        got = {r.doc_id: r for r in score(docs, train(docs, fold)).collect()}
        assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got.values())
        right = sum(got[d[0]].predicted == d[column] for d in data if d[0] in test)
        assert right >= 0.97 * len(test), (module.__name__, right, len(test))


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", None, None, None), (2, "y " * 50_000, "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (99, 1, 1), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    for train, score in ((toxicity.train_toxicity, toxicity.score_toxicity), (quality.train_quality, quality.score_quality)):
        for given in (labels, none):
            got = score(docs.withColumn("label", F.lit(7)), train(docs, given)).collect()
            assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.label == 7 for r in got)
        assert score(docs.limit(0), train(docs.limit(0), labels)).collect() == []


def test_own_columns_stay_and_the_largest_label_counts(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "c d", 6, "y")], "doc_id int, text string, Score int, predicted string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    settled = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    for train, score in ((toxicity.train_toxicity, toxicity.score_toxicity), (quality.train_quality, quality.score_quality)):
        got = score(docs, train(docs, labels)).orderBy("doc_id").collect()
        assert [(r.doc_id, r.Score_input, r.predicted_input) for r in got] == [(1, 5, "x"), (2, 6, "y")]
        assert [r.score for r in got] == [r.score for r in score(docs, train(docs, settled)).orderBy("doc_id").collect()]


def test_scores_follow_from_the_weights(spark):
    """Score is the logistic of the intercept and the weights of the distinct features, row by row."""
    import math

    import numpy as np
    import pyarrow as pa

    from varispark.llm.ftrl import slots

    data = rows(300)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in data], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data], "doc_id bigint, quality int, toxic int")
    for module, train, score in ((toxicity, toxicity.train_toxicity, toxicity.score_toxicity), (quality, quality.train_quality, quality.score_quality)):
        model = train(docs, labels)
        weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
        got = {r.doc_id: r.score for r in score(docs, model).collect()}
        for i, t, _, _ in data:
            (at,) = slots(pa.array([t.encode()]), module.features, model.bits)
            total = model.intercept + sum(weight.get(x, 0.0) for x in np.unique(at).tolist())
            assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-6
