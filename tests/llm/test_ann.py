import math

import numpy as np
from pyspark.sql import functions as F

from varispark.llm.ann import IvfParams, search

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i))[:k]
            out[i] = [j for _, j in s]
    return out


def run(spark, rows, p):
    got = search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, p).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def data(n, seed=1, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    x = (centres[r.integers(0, 12, n)] + 0.5 * r.normal(size=(n, d))).astype(np.float32)
    return [(i, x[i].tolist(), 0) for i in range(n)]


def test_recall(spark):
    rows = data(3000)
    got, want = run(spark, rows, IvfParams(k=10)), brute(rows, 10)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95


def test_copies_ties_and_odd_vectors(spark):
    rows = data(200)
    rows += [(i, rows[3][1], 0) for i in range(500, 900)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [1.0] * 15 + [None], 0), (1060, [float("nan")] * 16, 0), (1080, [float("inf")] + [1.0] * 15, 0), (1100, [], 0), (None, [1.0] * 16, 0)]
    p = IvfParams(k=20, probe_share=1.0)
    assert run(spark, rows, p) == brute(rows, 20)


def test_repeated_ids_and_the_frequent_dimension(spark):
    """Each row of an id is a vector of its own; a single odd vector sends nothing away."""
    rows = data(59)
    rows += [(40, rows[7][1], 0), (33, rows[33][1], 0)] + [(i, [1.0, 2.0], 0) for i in range(5000, 5020)]
    got = search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, IvfParams(k=5, probe_share=1.0)).collect()
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if len(v) == 16]
    want = []
    for at, (i, v) in enumerate(good):
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for k, (j, w) in enumerate(good) if k != at)[:5]
            want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
    assert sum(r.query_id == 40 for r in got) == 10


def test_recall_of_the_registered_query(spark):
    import pyarrow.parquet as pq

    from varispark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    want = brute(list(zip(t["vec_id"], t["embedding"], strict=True)), 20)
    got = {}
    for r in QUERIES["op7_ivf_pq"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()])
    assert got.keys() == want.keys() and recall >= 0.9, recall


def test_all_nearest_of_other_rows(spark):
    """Lengths of every order and near copies: each query has its very nearest, whatever lists and codes say."""
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16)) * np.exp(1.5 * r.normal(size=(1500, 1)))
    x[700:1100] = x[5] + 1e-4 * r.normal(size=(400, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    assert run(spark, rows, IvfParams(k=20)) == brute(rows, 20)
    assert run(spark, rows, IvfParams(k=20, probe_share=0.05, rerank=20)) == brute(rows, 20)


def test_few_and_none(spark):
    rows = data(6)
    assert run(spark, rows, IvfParams()) == brute(rows, 20)
    assert run(spark, rows[:1], IvfParams()) == {}
    assert run(spark, [], IvfParams()) == {}
