"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import queries, whitening


def dense(vectors, k):
    """Sums, deviations, eigenvalues and eigenvectors of the whole-number vectors, plainly."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    gap = n * x - s
    c = (gap / n).astype(float)
    values, basis = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return n, [int(v) for v in (gap * gap).sum(1)], values[order], basis[:, order], c, float((c * c).sum() / n)


def test_lanczos_finds_leading_pairs():
    r = np.random.default_rng(1)
    base = np.linalg.qr(r.standard_normal((240, 240)))[0]
    spectrum = np.sort(np.concatenate([[100, 50, 25, 12, 6], r.random(235)]))[::-1]
    matrix = (base * spectrum) @ base.T
    calls = []
    values, vectors, passes, residual = whitening.block_lanczos(lambda q: calls.append(q.shape) or matrix @ q, 240, 5, block=6)
    assert np.allclose(values, spectrum[:5], rtol=1e-12) and passes == len(calls) < 20 and residual <= whitening.TOLERANCE
    assert np.allclose(np.abs((vectors * base[:, :5]).sum(0)), 1, atol=1e-10)


@pytest.mark.parametrize("spectrum", [[5] * 4 + [1] * 16, [3] + [0] * 19, [7, 7, 7] + [0] * 17, list(range(20, 0, -1)), [1.0] * 20])
def test_lanczos_restarts_on_breakdown(spectrum):
    """Few distinct eigenvalues exhaust the Krylov space early; random restarts still find all wanted pairs."""
    r = np.random.default_rng(2)
    base = np.linalg.qr(r.standard_normal((20, 20)))[0]
    matrix = (base * np.array(spectrum, float)) @ base.T
    for block in (2, 3, 8, 32):
        values, vectors, _, _ = whitening.block_lanczos(lambda q: matrix @ q, 20, 10, block=block)
        assert np.allclose(values, spectrum[:10], atol=1e-10), (block, values)
        assert np.allclose(vectors.T @ vectors, np.eye(10), atol=1e-10) and np.allclose(matrix @ vectors, vectors * values, atol=1e-9)


def test_whitening_against_dense(spark):
    r = np.random.default_rng(3)
    data = r.standard_normal((700, 24)) @ np.diag(np.linspace(1.5, 0.2, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)] + [(0, [float(c) for c in data[0]])]
    rows += [(800, None), (801, []), (802, [None] * 24), (803, [float("nan")] * 24), (804, [float("inf")] + [0.0] * 23), (805, [1e300] * 24), (806, [0.1] * 5), (None, [0.5] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"Deviation": F.lit("clash"), "_x": F.lit(1)}).repartition(5)
    out, found, error = whitening.whiten(df, components=10)
    assert error <= 1e-9 and "_x" in out.columns
    got = {}
    for row in whitening.components(out, found, error).collect():
        got.setdefault(row.vec_id, []).append(row)
    used = [(i, v) for i, v in rows if i is None or i < 800]
    n, deviation, values, vectors, c, trace = dense([v for _, v in used], 10)
    z = c @ vectors / np.sqrt(values)
    assert found.n == n and set(got) == {i for i, _ in used} and len(got[0]) == 20
    sign = np.sign((found.vectors * vectors).sum(0))
    for (i, _), dev, want in zip(used, deviation, z, strict=True):
        own = sorted(got[i], key=lambda x: x.component)
        assert {x.deviation for x in own} == {dev}
        if i != 0:
            assert np.allclose([x.whitened for x in own], want * sign, atol=1e-9)
            assert np.allclose([x.explained for x in own], values / trace, rtol=1e-10)


def test_whitening_edge_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.components(*whitening.whiten(make(rows))).collect() == []
    # one direction only has variance
    line = whitening.components(*whitening.whiten(make([(i, [i / 64, 2 * i / 64, 0.0]) for i in range(5)]))).collect()
    assert {x.component for x in line} == {1} and len(line) == 5 and abs(line[0].explained - 1) < 1e-12
    assert len({x.deviation for x in line}) == 3
    assert whitening.deviations(np.array([[2**40, 0]]), 2**30, np.array([0, 2**50])) == [2**140 + 2**100]


def test_query(spark):
    rows = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, values, vectors, c, trace = dense(data["embedding"], 32)
    wide = rows.pivot(index="vec_id", columns="component", values="whitened")
    z = c @ vectors / np.sqrt(values)
    assert len(rows) == 32 * n and (rows["n"] == n).all() and rows["identity_error"].max() <= 1e-9
    assert np.allclose(np.abs(wide.to_numpy()), np.abs(z), atol=1e-7)
    assert rows.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == deviation
    assert np.allclose(rows.groupby("component").explained.first(), values / trace, rtol=1e-9)
