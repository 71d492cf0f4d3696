import numpy as np
import pytest

import __spark_entry__ as entry
from spanlake.llm import whitening

SF = "/root/testdata/sf0.01"


def plain(vectors, k=16):
    """x, n, S, eigenvalues and vectors by the dense symmetric solver."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], columns[:, ::-1][:, :k]


def test_query_against_the_dense_solver(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, n, sums, values, columns = plain([r["embedding"] for r in rows])
    want = ((x * n - sums) / n) @ columns / np.sqrt(values[:16])
    deviation = ((x * n - sums) ** 2).sum(axis=1).tolist()
    got = entry.queries()["op13_embedding_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = {}
    for r in got.collect():
        found[r["vec_id"], r["component"]] = r
    assert len(found) == 16 * len(rows)
    signs = np.sign([found[rows[0]["vec_id"], k + 1]["whitened"] for k in range(16)]) * np.sign(want[0])
    for i, row in enumerate(rows):
        for k in range(16):
            r = found[row["vec_id"], k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert r["whitened"] == pytest.approx(want[i, k] * signs[k], abs=1e-9)
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10) and r["identity_error"] < 1e-10


def matrices():
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    yield rng.standard_normal((300, 30)) * np.exp(3 * rng.standard_normal(30))  # wide range
    yield rng.standard_normal((300, 5)) @ rng.standard_normal((5, 30))  # low rank
    yield np.vstack([np.eye(30)] * 2)  # all equal
    yield np.kron(np.ones((3, 1)), np.diag(np.repeat([9.0, 9.0, 4.0], 10))) @ turn  # clusters
    yield rng.standard_normal((12, 30))  # fewer rows than dimensions
    yield np.outer(np.arange(9.0), np.eye(30)[4])  # one direction
    yield np.zeros((4, 30))
    yield np.diag(10.0 ** -np.arange(30)) @ turn  # graded


@pytest.mark.parametrize("number", range(8))
def test_solver(number):
    a = list(matrices())[number]
    r = np.linalg.qr(a, mode="r")
    r = np.vstack((r, np.zeros((30 - len(r), 30))))
    values, vectors, trace = whitening.directions(r, 1, 16)
    v = a.T @ a
    want = np.linalg.svd(a, compute_uv=False) ** 2
    k = len(values)
    assert k == min(16, int((want > max(want[0], 1e-300) * 1e-20).sum()))
    assert values == pytest.approx(want[:k].tolist(), rel=1e-9, abs=1e-15 * want[0]) and trace == pytest.approx(np.trace(v), rel=1e-12)
    if k:
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_bidiagonal_keeps_the_matrix():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((9, 9))
    d, e, v = whitening.bidiagonal(a)
    b = np.diag(d) + np.diag(e, 1)
    assert np.abs(v.T @ v - np.eye(9)).max() < 1e-14 and np.abs(v @ b.T @ b @ v.T - a.T @ a).max() < 1e-13
    assert whitening.dqds(d, e) == pytest.approx((np.linalg.svd(a, compute_uv=False) ** 2).tolist(), rel=1e-12)


def test_many_triangles(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, (700, 6))
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    n, sums = whitening.column_sums(frame)
    assert (n, sums) == (700, x.sum(axis=0).tolist())
    r = whitening.triangle(frame, n, sums, block=16, fan=3)
    centred = x - x.mean(axis=0)
    assert np.abs(r.T @ r / (centred.T @ centred) - 1).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", [1.0]) for i, v in rows], "vec_id long, embedding array<float>, n long, x string, whitened array<double>")


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 0.5, -1.0]), (3, [1.0, 0.5, -1.0]), (3, [1.0, 0.5, -1.0]), (None, [4.0, 4.0, 0.25]), (5, [0.01, 1.0, 2.0])]
    bad = [(6, None), (7, [None, 1.0, 2.0]), (8, [nan, 1.0, 2.0]), (9, [1.0, inf, 2.0]), (10, [1.0, -inf, 2.0]), (11, []), (12, [1.0, 2.0]), (13, [1.0] * 4)]
    got = whitening.whiten_embeddings(frame(spark, good + bad)).collect()
    x, n, sums, values, columns = plain([v for _, v in good], 2)
    assert n == 3  # equal after rounding down count once
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i or 0, k) for i, _ in good for k in (1, 2))
    deviations = {(i or 0): d for (i, _), d in zip(good, ((x * n - sums) ** 2).sum(axis=1).tolist())}
    assert all(r["deviation"] == deviations[r["vec_id"] or 0] and r["n"] == 3 and r["identity_error"] < 1e-9 for r in got)


def test_no_direction(spark):
    assert whitening.whiten_embeddings(frame(spark, [])).count() == 0
    assert whitening.whiten_embeddings(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten_embeddings(frame(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries(spark):
    got = whitening.whiten_embeddings(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.5])])).collect()
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {1, 2} and all(np.isfinite(r["whitened"]) for r in got)
