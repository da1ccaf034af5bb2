"""Neighbours, arcs, bad points, atmosphere and projection against brute force and known values."""

import math

import numpy as np
import pandas as pd
import pytest

from fringelake.functions.projection import utm
from fringelake.operators import atmosphere, estimation, graph, network, pixels
from fringelake.scratch import root


def _points(spark, yx):
    return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(yx)], "point_id long, y double, x double")


def _nearest(yx, k):
    d2 = ((yx[:, None, :] - yx[None, :, :]) ** 2).sum(axis=2)
    return {(i, int(j)) for i in range(len(yx)) for j in sorted(range(len(yx)), key=lambda j: (d2[i, j], j))[:k]}


def test_nearest_on_sparse_points(spark):
    """Clusters far apart and single points: each gets its k nearest, however far."""
    r = np.random.default_rng(2)
    yx = np.round(np.concatenate([r.normal((0, 0), 1, (30, 2)), r.normal((200, 50), 3, (20, 2)), [[1000, 1000], [-500, 3]]]), 2)
    p = _points(spark, yx)
    assert {(x.a, x.b) for x in pixels.nearest(p, p, 4, 0.5).collect()} == _nearest(yx, 4)
    assert pixels.nearest(p.limit(3), p.limit(2), 5, 1.0).count() == 6 and pixels.nearest(p, p.where("false"), 2, 1.0).count() == 0
    assert pixels.nearest(p.where("false"), p, 2, 1.0).count() == 0


def test_arcs_are_reconnected(spark):
    near, far = [(0, i) for i in range(5)], [(0, 40 + i) for i in range(5)]
    one = graph.build_arcs(_points(spark, near), 2, 1.5, 1.0).collect()
    assert {(x.src, x.dst) for x in one} == {(i + 1, i) for i in range(4)}
    two = graph.build_arcs(_points(spark, near + far), 2, 1.5, 1.0)
    assert graph.is_connected(_points(spark, near + far), two) and max(x.length for x in two.collect()) > 30


def _sequential(arcs, limit):
    """Bad points removed one by one; medians of neighbours are taken before the point goes."""
    near = {}
    for a, b, g in arcs:
        near.setdefault(a, {})[b] = g
        near.setdefault(b, {})[a] = g
    median = {p: float(np.median(list(near[p].values()))) for p in sorted(near)}
    while median:
        worst = min(median, key=median.get)
        if median[worst] >= limit:
            break
        for q in near[worst]:
            median[q] = float(np.median(list(near[q].values())))
        for q in near.pop(worst):
            near[q].pop(worst)
        del median[worst]
    return sorted(x for x in arcs if x[0] in median and x[1] in median)


@pytest.mark.parametrize("seed", [5, 6])
def test_bad_points(spark, seed):
    r = np.random.default_rng(seed)
    arcs = sorted({tuple(sorted((int(a), int(min(a + d, 69))), reverse=True)) for a, d in zip(r.integers(0, 70, 200), r.integers(1, 6, 200)) if a < 69})
    bad = r.random(70) < 0.25
    arcs = [(a, b, round(float(r.random() * (0.5 if bad[a] or bad[b] else 1)), 2)) for a, b in arcs]
    left = _sequential(arcs, 0.4)
    got = graph.without_bad_points(spark.createDataFrame(arcs, "src long, dst long, gamma double"), 0.4)
    assert sorted(map(tuple, got.collect())) == left and 0 < len(left) < len(arcs)
    assert graph.without_bad_points(got.where("false"), 0.5).count() == 0 and graph.without_bad_points(got, 0.0).count() == len(left)


def test_removal_follows_the_order_of_single_points():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(4, 14))
        arcs = [(a, b, round(float(r.random()), 1)) for a in range(n) for b in range(a) if r.random() < 0.5]
        ends = [(a, b, g) for a, b, g in arcs] + [(b, a, g) for a, b, g in arcs]
        gone = set(graph._removed(pd.DataFrame(ends, columns=["p", "q", "gamma"]), 0.5)) if arcs else set()
        assert sorted(x for x in arcs if not {x[0], x[1]} & gone) == _sequential(arcs, 0.5)


def test_kriging(spark):
    r = np.random.default_rng(3)
    yx = r.uniform(0, 20, (12, 2))
    value = r.standard_normal((12, 3))
    p = _points(spark, yx)
    seen = spark.createDataFrame([(i, k, float(value[i, k])) for i in range(10) for k in range(3)], "point_id long, k int, phase double")
    near = pixels.nearest(p, p.where("point_id < 10"), 4, 4.0)
    got = {(x.point_id, x.k): x.phase for x in atmosphere.krige(near, p, seen, 5.0, 2.0, 1e-9).collect()}
    for i in range(12):
        d = np.hypot(*(yx[:10] - yx[i]).T)
        n = np.argsort(d)[:4]
        c = lambda d: 2 * np.exp(-d / 5)
        w = np.linalg.solve(c(np.hypot(*(yx[n][:, None] - yx[n][None]).transpose(2, 0, 1))), c(d[n]))
        assert np.allclose([got[i, k] for k in range(3)], w @ value[n], atol=1e-6)
        if i < 10:
            assert np.allclose([got[i, k] for k in range(3)], value[i], atol=1e-6)
    plain = {(x.point_id, x.k): x.phase for x in atmosphere.by_distance(near, seen).collect()}
    assert all(abs(plain[i, 0] - value[i, 0]) < 1e-12 for i in range(10))


def test_utm(spark):
    row = spark.createDataFrame([(43.642567, -79.387139), (0.0, 3.0), (-33.9, 18.4)], "lat double, lon double").select(*utm("lat", "lon")).collect()
    assert row[0][0] == 17 and abs(row[0][1] - 630084) < 1 and abs(row[0][2] - 4833438) < 1
    assert row[1][0] == 31 and abs(row[1][1] - 500000) < 1e-6 and abs(row[1][2]) < 1e-6 and row[2][2] < 0


def test_small_rules(spark):
    acq = spark.createDataFrame([(i, 12.0 * i, 1.0 * i * i) for i in range(6)], "idx int, tbase double, pbase double")
    with pytest.raises(ValueError):
        network.of_type("tree", acq)
    got = {tuple(x)[:2]: tuple(x)[2:] for x in network.with_baselines(network.of_type("stb", acq, 1), acq).collect()}
    assert got[2, 3] == (12 / 365.25, 5.0) and len(got) == 5
    with pytest.raises(ValueError):
        pixels.metric_edges(10, 10, 90.0, 90.0, 0.0)
    assert pixels.metric_edges(10, 20, 90.0, 19.0, 50.0) == ([0, 5, 10], [0, 20])
    few = spark.createDataFrame([(i, 0, float(i)) for i in range(9)], "point_id long, k int, phase double")
    rates = spark.createDataFrame([(i, r) for i, r in enumerate([0.0, 0.01, 0.02, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])], "point_id long, rate double")
    assert {x.point_id: x.phase for x in estimation.to_histogram_peak(few, rates).collect()} == {i: i - 1.0 for i in range(9)}
    assert estimation.velocity(spark.createDataFrame([(1, 1e9 + t, 3.0 * t + 1) for t in (0.0, 1.0, 2.0)] + [(2, 5.0, 1.0)], "point_id long, t double, value double")).where("point_id = 2").first().slope is None
    rows = spark.createDataFrame([(0, math.nan), (1, None), (2, 1.5)], "point_id long, bmap double")
    assert [x.point_id for x in pixels.valid(rows, "bmap").collect()] == [2]


def test_shared_folder(spark):
    assert root(spark).startswith(("file:", "/"))


def test_threads_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from fringelake import scratch

    own = scratch.scratch(spark.range(3), "kept")

    def other():
        began = scratch.made()
        scratch.scratch(spark.range(2), "gone")
        scratch.discard_since(began)
        return scratch.made()

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(other).result() == 0
    assert own.count() == 3
