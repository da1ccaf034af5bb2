"""Elimination on networks against dense least squares, and unwrapping in space against simulated truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions.morton import ranked
from fringelake.operators import elimination


def _lattice(r, height, width, share=0.95):
    y, x = np.divmod(np.arange(height * width), width)
    arcs = [(i, (y[i] + dy) * width + x[i] + dx) for i in range(height * width) for dy, dx in ((0, 1), (1, 0), (1, 1)) if y[i] + dy < height and x[i] + dx < width and r.random() < share]
    return y, x, np.array(arcs)


def _places(spark, y, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "point_id long, y double, x double")


def test_integration_by_dense_least_squares(spark, monkeypatch):
    r = np.random.default_rng(0)
    y, x, arcs = _lattice(r, 11, 13)
    n, reference = 143, 37
    values, weight = r.standard_normal((len(arcs), 2)), 0.2 + r.random(len(arcs))
    a = np.zeros((len(arcs), n))
    a[np.arange(len(arcs)), arcs[:, 0]], a[np.arange(len(arcs)), arcs[:, 1]] = 1, -1
    want = np.linalg.lstsq(weight[:, None] * np.delete(a, reference, 1), weight[:, None] * values, rcond=None)[0]
    rows = [(int(s), int(d), float(v[0]), float(v[1]), float(w)) for (s, d), v, w in zip(arcs, values, weight)]
    frame = spark.createDataFrame(rows, "src long, dst long, vel double, demerr double, weight double")
    monkeypatch.setattr(elimination, "TILE", 4)  # three levels
    got = {g.point_id: (g.vel, g.demerr) for g in elimination.integrate(frame, _places(spark, y, x), reference, ["vel", "demerr"]).collect()}
    assert got[reference] == (0, 0) and np.allclose([got[i] for i in range(n) if i != reference], want, atol=1e-9)
    apart = frame.unionByName(spark.createDataFrame([(n, n + 1, 0.0, 0.0, 1.0)], frame.schema))
    more = _places(spark, [*y, 3, 3.2], [*x, 4.5, 4.6])
    for wrong, ref in ((apart, reference), (frame, n)):
        with pytest.raises(elimination.NotConnected):
            elimination.integrate(wrong, more, ref, ["vel"])


def test_wide_networks(spark, monkeypatch):
    rows = [(i, i + 1, 1.0, 1.0) for i in range(5)] + [(0, 5, -5.0, 2.0), (1, 4, -3.3, 1.0)]
    frame, places = spark.createDataFrame(rows, "src long, dst long, v double, weight double"), _places(spark, [0] * 6, range(6))
    want = {g.point_id: g.v for g in elimination.integrate(frame, places, 0, ["v"]).collect()}
    monkeypatch.setattr(elimination, "FRONT", 3)
    got = {g.point_id: g.v for g in elimination.integrate(frame, places, 0, ["v"]).collect()}  # by conjugate gradients
    assert got == pytest.approx(want, abs=1e-6)
    with pytest.raises(elimination.TooWide):
        elimination.unwrap(spark.createDataFrame([(i, 0, 0.0) for i in range(6)], "point_id long, k int, phase double"), frame, places, 0)


def test_arcs_given_twice_or_turned_round(spark):
    rows = [(0, 1, 1.0, 1.0), (1, 0, -2.0, 1.0), (2, 1, 3.0, 0.5), (2, 2, 9.0, 1.0)]
    frame = spark.createDataFrame(rows, "src long, dst long, v double, weight double")
    got = {g.point_id: g.v for g in elimination.integrate(frame, _places(spark, [0, 0, 1], [0, 1, 1]), 0, ["v"]).collect()}
    assert got == pytest.approx({0: 0, 1: -1.5, 2: 1.5})


def test_unwrapping_in_space(spark, monkeypatch):
    monkeypatch.setattr(elimination, "TILE", 6)
    r = np.random.default_rng(5)
    height, width, epochs = 13, 14, 5
    y, x, arcs = _lattice(r, height, width)
    truth = np.stack([0.3 * k * (y * 0.4 + x * 0.3) + 3 * np.sin(y / 5 + k) * np.cos(x / 6) for k in range(epochs)], 1)
    seen = truth + 0.35 * r.standard_normal(truth.shape)
    seen[60] += r.uniform(-3, 3, epochs)  # a point of noise
    psi = np.angle(np.exp(1j * seen))
    phases = spark.createDataFrame([(i, k, float(psi[i, k])) for i in range(height * width) for k in range(epochs)], "point_id long, k int, phase double")
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in arcs], "src long, dst long")
    out = elimination.unwrap(phases, frame, _places(spark, y, x), 7, size=3).collect()
    got = np.zeros(psi.shape)
    for g in out:
        got[g.point_id, g.k] = g.phase
    assert len(out) == psi.size and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    off = (got - psi - (got - psi)[7]) / (2 * np.pi)
    assert np.allclose(off, np.round(off), atol=1e-9)  # whole cycles, so every loop of arcs closes
    wrong = np.round((got - seen - (got - seen)[7]) / (2 * np.pi)) != 0
    assert wrong[np.arange(len(y)) != 60].sum() == 0 and np.ptp(truth[:, -1]) > 2 * np.pi
    assert elimination.unwrap(phases.where("k = 0"), frame, _places(spark, y, x), 7, rounds=1).count() == height * width


def test_ranks(spark):
    r = np.random.default_rng(2)
    yx = r.integers(0, 8, (40, 2))
    got = {g.point_id: g["rank"] for g in ranked(_places(spark, yx[:, 0], yx[:, 1])).collect()}

    def order(i):
        fine = [min(int((c - m) / 7 * 2**20), 2**20 - 1) for c, m in zip(yx[i], yx.min(axis=0))]
        return sum(((fine[0] >> b & 1) << (2 * b + 1)) | ((fine[1] >> b & 1) << (2 * b)) for b in range(20)), i

    assert np.ptp(yx[:, 0]) == np.ptp(yx[:, 1]) == 7
    assert [got[i] for i in sorted(range(40), key=order)] == list(range(40))
    one = ranked(_places(spark, [5.0], [5.0]).withColumn("z", F.lit(1)))
    assert [tuple(g) for g in one.collect()] == [(0, 0)] and ranked(_places(spark, [5.0], [5.0]).where("false")).count() == 0


def test_tiles_joined_over_jobs(spark, monkeypatch):
    """Two levels in the first job and one or two in each later one, as many elements in an array as borders allow."""
    for name, value in (("TILE", 2), ("NEST", 1), ("JOIN", 0), ("TOGETHER", 300)):
        monkeypatch.setattr(elimination, name, value)
    assert elimination._steps(142) == [(2, 4), (6,), (8,)]
    r = np.random.default_rng(4)
    y, x, arcs = _lattice(r, 11, 13, 1.0)
    w, f = 0.5 + r.random((len(arcs), 2)), r.standard_normal((len(arcs), 4))
    frame = spark.createDataFrame([(0, int(a), int(b), [float(v) for v in p], [float(v) for v in q]) for (a, b), p, q in zip(arcs, w, f)], "part int, a long, b long, w array<double>, f array<double>")
    got = {g.node: g.x for g in elimination.solve(frame, 142, 37).collect()}
    design = np.zeros((len(arcs), 143))
    design[np.arange(len(arcs)), arcs[:, 0]], design[np.arange(len(arcs)), arcs[:, 1]] = 1, -1
    design = np.delete(design, 37, 1)
    want = np.concatenate([np.linalg.solve(design.T @ (w[:, e, None] * design), design.T @ f[:, 2 * e : 2 * e + 2]) for e in (0, 1)], axis=1)
    assert got[37] == [0] * 4 and np.allclose([got[i] for i in range(143) if i != 37], want, atol=1e-9)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in arcs], "a long, b long")
    ends = [{int(n) for p in arcs if p[0] >> s != p[1] >> s for n in p} for s in (4, 6, 8)]
    assert elimination._widest(pairs, 142) == max(sum(n >> s == t for n in e) for s, e in zip((4, 6, 8), ends) for t in range(9))
