"""The cluster index against brute force."""

import numpy as np
import pytest

from lotwise.operators import matching, vector_index


def clustered(n, d, groups, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, d))
    return [(i, [float(x) for x in centres[i % groups] + spread * r.standard_normal(d)]) for i in range(n)]


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = np.round(x @ x[np.flatnonzero(ids == i)[0]], 9)
        out[i] = [int(v) for v in ids[np.lexsort((ids, -s))][:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("broadcast,blocks", [(True, 4096), (False, 40)])
def test_exact_search(spark, monkeypatch, broadcast, blocks):
    """All modes of joining, blocks smaller than cells, a third of equal vectors, unusable rows."""
    if not broadcast:
        monkeypatch.setattr(vector_index, "small_side", lambda df: df)
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", blocks)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 5)
    rows = clustered(600, 8, 12, 0.2, 1) + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(300)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [])]
    df = frame(spark, rows + odd)
    index = vector_index.build(df, clusters=16)
    queries = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found, read = vector_index.search(index, queries, 7)
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == brute(rows, [i for i, _ in rows if i % 20 == 0], 7)
    seen = vector_index.reads(index, read).toPandas()
    assert seen["vectors"].mean() < 0.6 * len(rows) and (seen["vectors"] >= 7).all() and read.count() == read.distinct().count()


def test_probe_recall(spark):
    df = frame(spark, clustered(900, 16, 20, 0.3, 2))
    index = vector_index.build(df, clusters=20)
    queries = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = lambda probes: {(x.query_id, x.vec_id) for x in vector_index.search(index, queries, 10, probes)[0].collect()}
    exact = pairs(None)
    assert len(exact & pairs(6)) >= 0.9 * len(exact) and len(pairs(1)) == len(exact)


def test_same_as_brute_force_operator(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    want = {(x.query_id, x["rank"], x.vec_id) for x in matching.top_k(queries, df, 10).collect()}
    assert {(x.query_id, x["rank"], x.vec_id) for x in vector_index.search(vector_index.build(df), queries, 10)[0].collect()} == want


def test_edge_cases(spark):
    empty = frame(spark, [])
    index = vector_index.build(empty)
    assert vector_index.search(index, empty.withColumnRenamed("vec_id", "query_id"), 3)[0].count() == 0
    few = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    got = vector_index.search(vector_index.build(few), few.withColumnRenamed("vec_id", "query_id"), 5)[0].orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.vec_id, x.score) for x in got] == [(1, 1, 1.0), (1, 2, 0.0), (2, 2, 1.0), (2, 1, 0.0)]
