"""Variogram fits, kriging with them and linear interpolation against simulated truth and brute force."""

import numpy as np
import pytest

from fringelake.operators import atmosphere, pixels, variogram


def _points(spark, yx):
    return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(yx)], "point_id long, y double, x double")


def _values(spark, values):
    return spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(values) for k, v in enumerate(row)], "point_id long, k int, phase double")


def test_fit_finds_the_model():
    h = (np.arange(30) + 0.5) * 2
    truth = np.array([[2.0, 9.0, 1.0, 0.3], [1.0, 20.0, 1.8, 0.0], [0.4, 5.0, 0.7, 0.1], [5.0, 14.0, 1.5, 1.0]])
    gamma = np.stack([variogram.stable(h, *p) for p in truth])
    assert np.allclose(variogram.fit_all(h, gamma, np.ones_like(gamma)), truth, rtol=2e-2, atol=2e-3)
    noisy = gamma * (1 + 0.01 * np.random.default_rng(1).standard_normal(gamma.shape))
    p = variogram.fit_all(h, noisy, np.ones_like(gamma))
    close = np.stack([variogram.stable(h, *x) for x in p])
    assert (np.abs(close - gamma).max(axis=1) < 0.03 * gamma.max(axis=1)).all() and np.allclose(p[:, 0] + p[:, 3], truth[:, 0] + truth[:, 3], rtol=0.1)
    # a fit is no worse than the truth itself
    assert (((close - noisy) ** 2).sum(axis=1) <= ((gamma - noisy) ** 2).sum(axis=1) + 1e-12).all()
    few = np.ones_like(gamma)
    few[0, 3:] = 0
    gamma[1] = 0
    out = variogram.fit_all(h, gamma, few)
    assert np.isnan(out[:2]).all() and np.isfinite(out[2:]).all()
    only_nugget = variogram.fit_all(h, np.full((1, 30), 0.7), np.ones((1, 30)))[0]
    assert np.allclose(variogram.stable(h, *only_nugget), 0.7, atol=1e-3)


def test_variograms_of_all_epochs(spark):
    r = np.random.default_rng(3)
    yx = r.uniform(0, 30, (60, 2))
    values = r.standard_normal((60, 3)) + yx[:, :1] / 10
    reach, bins = 12.0, 6
    got = {(v.k, v.bin): v for v in variogram.empirical(_points(spark, yx), _values(spark, values), reach, bins).collect()}
    d = np.hypot(*(yx[:, None] - yx[None]).transpose(2, 0, 1))
    for k in range(3):
        for b in range(bins):
            i, j = np.nonzero(np.triu((d >= b * 2) & (d < b * 2 + 2), 1))
            v = got[k, b]
            assert v.n == len(i) and v.distance == 2 * b + 1 and np.isclose(v.semivariance, ((values[i, k] - values[j, k]) ** 2).mean() / 2)
    assert len(got) == 18 and variogram.empirical(_points(spark, yx), _values(spark, values), 0.0).count() == 0
    assert variogram.reach_of(_points(spark, [(0, 0), (30, 40)]), 0.5) == 25 and variogram.reach_of(_points(spark, [])) == 0
    fits = variogram.fitted(variogram.empirical(_points(spark, yx), _values(spark, np.c_[values, np.zeros(60)]), reach, bins)).collect()
    assert sorted(f.k for f in fits) == [0, 1, 2]  # an epoch that does not vary has no model


def test_kriging_with_a_model_for_each_epoch(spark):
    r = np.random.default_rng(4)
    yx = r.uniform(0, 20, (14, 2))
    values = r.standard_normal((11, 3))
    p = _points(spark, yx)
    near = pixels.nearest(p, p.where("point_id < 11"), 5, 4.0)
    models = [(0, 2.0, 6.0, 1.2, 0.1), (2, 1.0, 3.0, 0.8, 0.5)]
    got = {(x.point_id, x.k): x.phase for x in atmosphere.krige_fitted(near, p, _values(spark, values), spark.createDataFrame(models, variogram.MODEL)).collect()}
    for i in range(14):
        d = np.hypot(*(yx[:11] - yx[i]).T)
        n = np.argsort(d)[:5]
        for k, variance, length, power, nugget in models:
            c = lambda h: variance * np.exp(-((h / length) ** power))
            w = np.linalg.solve(c(np.hypot(*(yx[n][:, None] - yx[n][None]).transpose(2, 0, 1))) + nugget * np.eye(5), c(d[n]))
            assert got[i, k] == pytest.approx(w @ values[n, k], abs=1e-6)
        assert got[i, 1] == 0  # no model for this epoch


def _brute(q, p, values):
    """Linear interpolation by trying all triangles; beyond all of them the nearest value."""
    for i in range(len(p)):
        for j in range(i):
            for k in range(j):
                a = np.array([[*p[x], 1] for x in (i, j, k)]).T
                if abs(np.linalg.det(a)) < 1e-9:
                    continue
                w = np.linalg.solve(a, [*q, 1])
                if w.min() < -1e-12:
                    continue
                c = p[[i, j, k]]
                centre = np.linalg.solve(2 * (c[1:] - c[0]), (c[1:] ** 2).sum(axis=1) - (c[0] ** 2).sum())
                if (np.hypot(*(p - centre).T) >= np.hypot(*(c[0] - centre)) - 1e-9).all():
                    return w @ values[[i, j, k]]
    return values[np.hypot(*(p - q).T).argmin()]


def test_linear_interpolation_by_all_triangles(spark):
    r = np.random.default_rng(8)
    p = np.concatenate([r.normal(0, 1, (16, 2)), r.uniform(-9, 9, (14, 2))])
    q = np.concatenate([r.uniform(-10, 10, (25, 2)), r.normal(0, 1, (20, 2)), p[:4]])
    values = r.standard_normal((30, 2))
    targets = spark.createDataFrame([(100 + i, float(y), float(x)) for i, (y, x) in enumerate(q)], "point_id long, y double, x double")
    got = {(x.point_id - 100, x.k): x.phase for x in atmosphere.linear(targets, _points(spark, p), _values(spark, values), 1.0, 6).collect()}
    want = np.array([_brute(x, p, values) for x in q])
    assert np.allclose([[got[i, k] for k in range(2)] for i in range(len(q))], want, atol=1e-6)
    assert np.allclose(want[-4:], values[:4])
    few = atmosphere.linear(targets, _points(spark, p[:2]), _values(spark, values[:2]), 1.0).collect()  # no area: the nearest
    assert all(x.phase == values[np.hypot(*(p[:2] - q[x.point_id - 100]).T).argmin(), x.k] for x in few) and len(few) == 2 * len(q)


def test_triangles_hold_without_other_points():
    r = np.random.default_rng(9)
    p = r.uniform(0, 10, (400, 2))
    q = r.uniform(2, 8, (200, 2))
    tri, w, reach = atmosphere.triangles(q, np.broadcast_to(p, (200, 400, 2)))
    assert (tri >= 0).all() and np.allclose(w.sum(axis=1), 1) and (w > -1e-9).all() and np.allclose((w[:, :, None] * p[tri]).sum(axis=1), q)
    for t, at, far in zip(tri, q, reach):
        c = p[t]
        centre = np.linalg.solve(2 * (c[1:] - c[0]), (c[1:] ** 2).sum(axis=1) - (c[0] ** 2).sum())
        radius = np.hypot(*(c[0] - centre))
        assert np.hypot(*(p - centre).T).min() > radius - 1e-7 and np.isclose(far, radius + np.hypot(*(centre - at)), atol=1e-6)
