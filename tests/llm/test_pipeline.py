"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

import random

import pytest

from tests.llm.helpers import SCHEMA
from tests.llm.test_minhash import brute as near
from tests.llm.test_substring_dedup import brute as substrings

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(6)
    vocab = [f"word{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    rows, labels = [], []
    for i in range(240):
        words = [r.choice(vocab) for _ in range(r.randrange(60, 160))]
        toxic, good = i % 6 == 0, i % 5 != 1
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vile", "rotten"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words)
        if i % 20 == 4:
            text += "\n" + passage
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    for j in range(20):
        i, text, *_ = rows[7 * j + 2]
        rows.append((1000 + j, text if j % 2 else text + " tail", "en", "copy", len(text)))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    table = lambda df: sorted(tuple(x) for x in df.select(*columns).collect())
    before = table(docs)
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, sf_dir))
        if name == "packing":
            break
        assert docs.columns == columns
        now = table(docs)
        if name == "toxicity":
            gone = {x[0] for x in before} - {x[0] for x in now}
            assert sum(i % 6 == 0 for i in gone if i < 240) >= 36 and sum(i % 6 != 0 for i in gone if i < 240) <= 4
        elif name == "quality_classifier":
            assert sum(x[0] % 5 == 1 for x in now if x[0] < 240) <= 4
        elif name == "minhash_near_dedup":
            assert [x[0] for x in now] == [i for i, _, _, kept in near(before, 5) if kept]
        else:
            want = {i: n for i, _, n, _ in substrings(before)}
            texts = {x[0]: x[1] for x in before}
            assert sum(want.values()) > 0
            for i, text, *_, n_chars in now:
                assert n_chars == len(text)
                assert (text == texts[i]) if not want[i] else len(text.split()) == len(texts[i].split()) - want[i]
        before = now
    per_doc = {}
    for p in docs.collect():
        per_doc[p.doc_id] = per_doc.get(p.doc_id, 0) + p.length
        assert len(p.ids) == 4 * p.length
    assert per_doc.keys() == {x[0] for x in before}


def test_odd_rows_extra_columns_and_empty_tables(spark, sf_dir, tmp_path):
    from varispark.session import written

    schema = SCHEMA + ", chunk_id string, score double, place int, sequence_id int"
    more = ("c", 0.5, 1, 2)
    rows = [(1, None, "en", "s", 0, *more), (2, "", "en", "s", 0, *more), (3, "word1 " * 30_000, "en", "s", 0, *more), (5, "word2 word3 word4 word5 word6 word7", "en", "s", 0, *more), (5, "word2 word3 word4 word5 word6 word7", "en", "s", 0, *more), (None, "word8 word9", None, None, None, *more)]
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    near = dict(pipeline.STAGES)["minhash_near_dedup"](spark, docs, d)
    assert near.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.chunk_id, r.score, r.place) for r in near.collect()) == [(False, i, "c", 0.5, 1) for i in (1, 2, 3, 5)] + [(True, 0, "c", 0.5, 1)]
    cut = dict(pipeline.STAGES)["substring_dedup"](spark, docs, d)
    assert cut.columns == docs.columns and cut.count() == 6
    before = written()
    got = pipeline.run(spark, d)
    assert got.count() >= 0 and written() == before + 1
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert pipeline.run(spark, d).collect() == []
