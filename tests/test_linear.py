"""Singular vectors and eigenvectors that stay in tables, against numpy."""

import math

import numpy as np
import pytest

from lodestone.operators import spectral, svd


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(2)
    return (rng.random((60, 90)) < 0.1) * rng.random((60, 90)) + (rng.random((60, 3)) @ rng.random((3, 90))) * (rng.random((60, 90)) < 0.2)


class TestLatent:
    def test_captures_what_the_exact_one_does(self, spark, matrix):
        cells = [(i, f"f{j:03}", float(matrix[i, j])) for i in range(60) for j in range(90) if matrix[i, j]]
        made = svd.latent(spark.createDataFrame(cells, "row long, feature string, value double").repartition(7), 5)
        exact = np.linalg.svd(matrix)[1]
        assert made.captured == pytest.approx((exact[:5] ** 2).sum() / (matrix**2).sum(), rel=0.01)
        assert made.singular[0] == pytest.approx(exact[0], rel=1e-6)
        right = np.array([r["vector"] for r in made.features.orderBy("feature").collect()])
        assert np.abs(right.T @ right - np.eye(5)).max() < 1e-9
        rows = {r["row"]: r["vector"] for r in made.rows.collect()}
        want = matrix @ right
        want /= np.linalg.norm(want, axis=1)[:, None]
        assert len(rows) == 60 and max(np.abs(np.array(rows[i]) - want[i]).max() for i in rows) < 0.1

    def test_small_rank_is_exact(self, spark):
        rng = np.random.default_rng(0)
        m = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 7))
        df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(7)], "row long, feature long, value double")
        made = svd.latent(df, 4)
        assert len(made.singular) == 2 and made.captured == pytest.approx(1)
        assert svd.latent(df.limit(0), 4).rows.collect() == []

    def test_orthonormal_blocks(self, spark):
        rng = np.random.default_rng(1)
        x = rng.normal(size=(50, 3))
        x[:, 2] = x[:, 0] * 1e6 + x[:, 1] * 1e-3
        df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "row long, q0 double, q1 double, q2 double").repartition(6)
        q = np.array([list(r)[1:] for r in svd.orthonormal(df, "row", 3).orderBy("row").collect()])
        full = [k for k in range(3) if np.linalg.norm(q[:, k]) > 0.5]
        assert np.abs(q[:, full].T @ q[:, full] - np.eye(len(full))).max() < 1e-12 and len(full) >= 2

    def test_folded(self, spark):
        words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vector array<double>")
        tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (None, "b")], "doc_id long, word string")
        got = {r["doc_id"]: r["vector"] for r in svd.folded(tokens, words, 2).collect()}
        v = np.array([1 + math.log(2), 2.0])
        assert got[1] == pytest.approx(list(v / np.linalg.norm(v))) and got[2] == [0, 0] and got[None] == [0, 1]


class TestSpectral:
    def test_against_dense_eigenvectors(self, spark):
        rng = np.random.default_rng(4)
        rows = [(0, e, int(n), 1.0 + e % 3) for e in range(30) for n in rng.choice(20, size=rng.integers(2, 6), replace=False)]
        rows += [(7, 1, 100, 1.0), (7, 1, 101, 1.0), (8, 1, 200, 2.0), (9, 1, 300, 1.0), (9, 1, 301, 1.0), (9, 1, 302, 1.0), (9, 1, 302, 1.0)]
        df = spark.createDataFrame(rows, "part long, edge long, node long, weight double")
        out = spectral.spectral(df, restarts=2).orderBy("node").collect()
        own = [r for r in rows if r[0] == 0]
        nodes = sorted({r[2] for r in own})
        h, w = np.zeros((len(nodes), 30)), np.zeros(30)
        for _, e, n, x in own:
            h[nodes.index(n), e], w[e] = 1, x
        d = h @ w
        m = (h * (w / h.sum(0))) @ h.T / np.sqrt(np.outer(d, d))
        exact = np.linalg.eigvalsh(m)[::-1]
        mine = [r for r in out if r["part"] == 0]
        assert (mine[0]["lambda_x"], mine[0]["lambda_y"]) == pytest.approx(tuple(exact[1:3]), abs=1e-9) and mine[0]["residual"] < 1e-6
        for name, value in (("x", "lambda_x"), ("y", "lambda_y")):
            v = np.array([r[name] for r in mine])
            assert np.linalg.norm(m @ v - mine[0][value] * v) < 1e-6 and np.linalg.norm(v) == pytest.approx(1) and abs(v @ np.sqrt(d)) < 1e-9
            assert v[np.abs(v).argmax()] > 0
        assert mine[0]["objective"] == pytest.approx(2 - exact[1] - exact[2])
        rest = {r["part"]: r["objective"] for r in out if r["part"]}
        assert rest == pytest.approx({7: 1, 8: 0, 9: 2})
        assert [(r["x"], r["y"]) for r in out if r["part"] == 8] == [(0, 0)]
