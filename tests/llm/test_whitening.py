"""Whitening against numpy in extended precision, on given vectors and on edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import whitening

SF = "/root/testdata/sf0.001"
SHAPE = "vec_id bigint, embedding array<float>"


def brute(vectors):
    """n, deviations and whitened entries (components in columns) by plain arithmetic."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], dtype=np.longdouble) / n
    v = (centred.T @ centred / n).astype(np.float64)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    return n, deviation, centred.astype(np.float64) @ w / np.sqrt(e), e / np.trace(v)


def test_given_vectors_and_edge_rows(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    good = [r.embedding for r in given.orderBy("vec_id").collect()]
    bad = [(-1, None), (-2, [None] * 64), (-3, [float("nan")] * 64), (-4, [float("inf")] + [0.0] * 63), (-5, [0.5]), (-6, []), (-7, [1e30] * 64)]
    hot = [(None, good[0])] + [(10_000, good[1])] * 300
    rows = given.unionByName(spark.createDataFrame(bad + hot, SHAPE))
    rows = rows.withColumns({c: F.lit("x") for c in ("n", "whitened", "deviation", "sums", "component")}).repartition(7)
    n, deviation, white, share = brute(good + [v for _, v in hot])
    got = whitening.whiten(rows).toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert sorted(got["component"].unique()) == list(range(1, 9))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    for i, (one, part) in enumerate(zip(sorted(set(range(len(good)))), good)):
        if i % 50:
            continue
        mine = got[got["vec_id"] == one].sort_values("component")
        assert set(mine["deviation"]) == {deviation[i]}
        assert np.allclose(np.abs(mine["whitened"]), np.abs(white[i, :8]), atol=1e-9)
    assert len(got[got["vec_id"] == 10_000]) == 8 * 300 and got["vec_id"].isna().sum() == 8
    means = got.groupby("component")["explained"].first()
    assert np.allclose(means, share[:8], rtol=1e-10)


def test_empty_constant_and_short_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], SHAPE)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SHAPE)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.5, 0.5])], SHAPE)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None and r.explained is None for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], SHAPE)).orderBy("vec_id", "component").collect()
    assert [r.whitened for r in line] == [-1.0, None, 1.0, None] and [r.explained for r in line] == [1.0, 0.0, 1.0, 0.0]
    wide = whitening.whiten(spark.createDataFrame([(1, [2.0**20]), (2, [-(2.0**20)])], SHAPE)).collect()
    assert {r.deviation for r in wide} == {(2**31) ** 2} and {abs(r.whitened) for r in wide} == {1.0}


def test_deviation_beyond_a_long_is_null_and_below_exact(spark):
    rows = spark.createDataFrame([(i, [0.0]) for i in range(2999)] + [(5000, [2.0**20])], SHAPE)
    got = {r.vec_id: r.deviation for r in whitening.whiten(rows).collect()}
    top = 1024 * 2**20
    assert got[0] == top**2 if top**2 < 2**63 else got[0] is None
    assert got[5000] is None  # (2999 * 2**30) ** 2


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5],  # apart
    [3, 3, 3, 2, 2, 1],  # equal
    [1 + 3e-9, 1 + 2e-9, 1 + 1e-9, 1, 0.5, 1e-6],  # close: float32 can't tell them apart
    [1e8, 1e8 - 1e-4, 1, 1 - 1e-9, 1e-8, 0],
])
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (3 * np.eye(6) - q.T @ q) / 2
    v = ((q * np.array(values, np.longdouble)) @ q.T).astype(np.float64)
    v = (v + v.T) / 2
    e, x = whitening.eigen(v)
    wide = x.astype(np.longdouble)
    size = max(values)
    assert np.abs(e - values).max() < 4e-15 * size and (np.diff(e) <= 0).all()
    assert np.abs(wide.T @ wide - np.eye(6)).max() < 2e-15
    assert np.abs(v @ wide - wide * e).max() < 4e-15 * size
    first = np.linalg.eigh(v.astype(np.float32))[1].astype(np.float64)
    assert np.abs(first.T @ v @ first - np.diag(np.diag(first.T @ v @ first))).max() > 1e-9 * size  # what had to be corrected


def test_vectors_of_close_eigenvalues_are_told_apart():
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(5, 5)))[0]
    v = (q * np.array([2, 2 - 1e-7, 1, 0.5, 0.1])) @ q.T
    e, x = whitening.eigen((v + v.T) / 2)
    best = np.linalg.eigh((v + v.T) / 2)[1][:, ::-1]
    assert np.allclose(np.abs((x * best).sum(axis=0)), 1, atol=1e-12) and abs(e[0] - e[1] - 1e-7) < 1e-14


def test_moments_merge_as_one_block():
    x = np.random.default_rng(5).integers(99_000, 101_000, (500, 4))
    parts = [whitening.of_block(p) for p in np.array_split(x, 7)]
    held = parts[0]
    for one in parts[1:]:
        held = held.merged(one)
    assert held.n == 500 and held.sums == x.sum(axis=0).tolist()
    assert np.allclose(held.scatter / 500, np.cov(x.T, bias=True), rtol=1e-12)
