"""Least-squares fits against a direct solver, random rows under any partitioning."""

import numpy as np
import pytest

from framewise.operators import geometry
from framewise.sources import tables


def direct(x, y, u, v):
    """The homography by a singular value decomposition of all equations, on centred points of unit spread."""
    def unit(a, b):
        s = np.sqrt(a.var() + b.var())
        return (a - a.mean()) / s, (b - b.mean()) / s, np.array([[1 / s, 0, -a.mean() / s], [0, 1 / s, -b.mean() / s], [0, 0, 1]])

    x, y, t = unit(x, y)
    u, v, to = unit(u, v)
    o, i = np.zeros_like(x), np.ones_like(x)
    rows = np.vstack([np.stack([x, y, i, o, o, o, -u * x, -u * y, -u], 1), np.stack([o, o, o, x, y, i, -v * x, -v * y, -v], 1)])
    h = np.linalg.inv(to) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t
    return h / h[2, 2]


def noisy(width, height, shift=0.0, n=60):
    g = np.random.default_rng(5)
    x, y = g.uniform(0, width, n) + shift, g.uniform(0, height, n) + shift
    h = np.array([[0.3, 0.05, 200.0], [0.02, 0.8, 90.0], [1e-5, 4e-5, 1.0]])
    w = h[2] @ np.stack([x - shift, y - shift, np.ones(n)])
    u, v = (h[k] @ np.stack([x - shift, y - shift, np.ones(n)]) / w + g.normal(0, 2, n) for k in (0, 1))
    return x, y, u, v


@pytest.mark.parametrize("width,height,shift", [(3840, 2160, 0.0), (1280, 720, 0.0), (0.4, 0.2, 0.0), (3840, 2160, 1e5)])
def test_noisy_pairs_agree_with_a_direct_solver(spark, width, height, shift):
    x, y, u, v = noisy(width, height, shift)
    rows = [(0, 3, float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x, y, u, v)]
    rows += [(0, 3, None, 1.0, 1.0, 1.0)] + [(0, 4, 1.0, 2.0, 3.0, 4.0)] * 3
    pairs = spark.createDataFrame(rows, "video_id long, frame long, x double, y double, map_x double, map_y double")
    fitted = geometry.fit_homography(pairs)
    (row,) = fitted.collect()
    h = direct(x, y, u, v)
    assert row["n_points"] == 60
    assert np.allclose(np.array(row["h"]).reshape(3, 3), h, rtol=1e-6, atol=1e-9)
    back = h @ np.stack([x, y, np.ones(60)])
    want = np.hypot(back[0] / back[2] - u, back[1] / back[2] - v)
    residuals = geometry.fit_residuals(pairs, fitted).collect()
    got = sorted(r["residual"] for r in residuals if r["residual"] is not None)
    assert got == pytest.approx(sorted(want), abs=1e-4) and len(residuals) == 64


def test_random_rows_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id % 7 AS video_id", "id AS frame")
    want = tables.random_rows(df, 30, seed=3).collect()
    assert len(set(want)) == 30
    for n in (1, 5, 40):
        assert tables.random_rows(df.repartition(n), 30, seed=3).collect() == want
    assert tables.random_rows(df, 30, seed=4).collect() != want
    assert tables.random_rows(df.limit(0), 30).collect() == []
