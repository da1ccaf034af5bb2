"""Networks and unwrapping against brute force and simulated truth."""

import numpy as np
import pytest

from fringelake.operators import graph, pixels, unwrapping


def _frame(spark, arcs, columns):
    return spark.createDataFrame(arcs, columns)


def _random_arcs(seed, n, m):
    r = np.random.default_rng(seed)
    pairs = {tuple(sorted(map(int, r.choice(n, 2, replace=False)))) for _ in range(m)}
    return [(a, b, round(float(r.random()), 2)) for a, b in sorted(pairs)]


def _roots(nodes, arcs):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    used = []
    for a, b, *_ in arcs:
        lo, hi = sorted((find(a), find(b)))
        if lo != hi:
            up[hi] = lo
            used.append((a, b))
    return {x: find(x) for x in nodes}, set(used)


def test_components_and_forest(spark):
    arcs = _random_arcs(1, 40, 34)
    points = spark.range(40).withColumnRenamed("id", "point_id")
    frame = _frame(spark, arcs, "src long, dst long, cost double")
    roots, _ = _roots(range(40), arcs)
    assert {r.point_id: r.component for r in graph.components(points, frame).collect()} == roots
    assert not graph.is_connected(points, frame) and graph.is_connected(points.where("false"), frame)
    _, tree = _roots(range(40), sorted(arcs, key=lambda x: (x[2], x[0], x[1])))
    assert {(r.src, r.dst) for r in graph.spanning_forest(frame).collect()} == tree
    assert graph.spanning_forest(frame.where("false")).count() == 0
    gamma = frame.withColumnRenamed("cost", "gamma")
    _, best = _roots(range(40), sorted(arcs, key=lambda x: (1 - x[2], x[0], x[1])))
    assert {(r.src, r.dst) for r in graph.without_bad_arcs(gamma, 0.7).collect()} == best | {(a, b) for a, b, g in arcs if g >= 0.7}


def test_integration(spark):
    r = np.random.default_rng(4)
    arcs = [(i, i + 1) for i in range(11)] + [(0, 5), (3, 9), (2, 11)]
    value, weight = r.standard_normal(len(arcs)), 0.2 + r.random(len(arcs))
    a = np.zeros((len(arcs), 12))
    for i, (s, d) in enumerate(arcs):
        a[i, s], a[i, d] = 1, -1
    want = np.linalg.lstsq(weight[:, None] * np.delete(a, 4, 1), weight * value, rcond=None)[0]
    frame = _frame(spark, [(s, d, float(v), float(w)) for (s, d), v, w in zip(arcs, value, weight)], "src long, dst long, value double, weight double")
    got = {x.point_id: x.value for x in graph.integrate(frame, 4).collect()}
    assert np.allclose([got[i] for i in range(12) if i != 4], want, atol=1e-6) and got[4] == 0
    with pytest.raises(ValueError):
        graph.integrate(frame.unionByName(_frame(spark, [(50, 51, 0.0, 1.0)], frame.schema)), 4)


def _wrapped(x):
    return np.angle(np.exp(1j * x))


def test_unwrapping_finds_the_truth(spark):
    r = np.random.default_rng(7)
    k = np.arange(40)
    base, time = r.uniform(-1, 1, 40), k / 20
    design = _frame(spark, [(int(i), float(b), float(t)) for i, b, t in zip(k, base, time)], "k int, of_demerr double, of_vel double")
    truth = {i: (float(r.uniform(-8, 8)), float(r.uniform(-12, 12))) for i in range(1, 16)}
    phase = {i: _wrapped(base * d + time * v + 0.2 * r.standard_normal(40)) for i, (d, v) in truth.items()}
    seen = _frame(spark, [(i, 0, int(j), float(p[j])) for i, p in phase.items() for j in k], "src long, dst long, k int, phase double")
    got = {x.src: x for x in unwrapping.unwrap_arcs(seen, design, 10.0, 15.0, 100).collect()}
    grid = np.linspace(-15, 15, 61)
    for i, (d, v) in truth.items():
        coarse = max(abs(np.mean(np.exp(1j * (phase[i] - base * a - time * b)))) for a in grid[np.abs(grid) <= 10] for b in grid)
        assert got[i].gamma >= coarse - 0.02 or abs(got[i].gamma - coarse) < 0.05
        assert abs(got[i].demerr - d) < 0.5 and abs(got[i].vel - v) < 0.5, i
    assert unwrapping.unwrap_arcs(seen.where("false"), design, 10.0, 15.0).count() == 0


def test_densification(spark):
    r = np.random.default_rng(9)
    base, time = r.uniform(-1, 1, 30), np.arange(30) / 15
    design = _frame(spark, [(i, float(base[i]), float(time[i])) for i in range(30)], "k int, of_demerr double, of_vel double")
    first = _frame(spark, [(p, k, float(0.1 * r.standard_normal())) for p in (1, 2, 3) for k in range(30)], "point_id long, k int, phase double")
    second = _frame(spark, [(9, k, float(_wrapped(base[k] * 3 - time[k] * 5))) for k in range(30)], "point_id long, k int, phase double")
    near = _frame(spark, [(9, b) for b in (1, 2, 3)], "a long, b long")
    got = unwrapping.densify(second, first, near, design, 6.0, 10.0).collect()
    assert len(got) == 1 and abs(got[0].demerr - 3) < 0.2 and abs(got[0].vel + 5) < 0.2 and got[0].gamma > 0.95


def test_box_edges():
    assert pixels.box_edges(100, 3) == [0, 33, 66, 100] and pixels.box_edges(25, 4) == [0, 6, 12, 18, 25]
    assert pixels.box_edges(10, 4) == [0, 2, 4, 6, 8, 10] and pixels.box_edges(3, 1) == [0, 3]


def test_many_boxes(spark):
    """Thousands of boxes along one axis are no deeper an expression than a few; what is outside of all has no number."""
    edges = pixels.box_edges(9000, 4000)
    at = [-1, 0, 1, 2, 3, 4444, 8997, 8999, 9000]
    rows = spark.createDataFrame([(i, y, y % 3) for i, y in enumerate(at)], "point_id long, y int, x int")
    got = {g.point_id: (g.box_y, g.box_x) for g in pixels.boxed(rows, edges, [1, 2, 7]).collect()}
    between = lambda v, e: next((i for i in range(len(e) - 1) if e[i] <= v < e[i + 1]), None)
    assert len(edges) > 4000 and got == {i: (between(y, edges), between(y % 3, [1, 2, 7])) for i, y in enumerate(at)}


def test_search_in_small_pieces(spark, monkeypatch):
    """Rows are searched a few at a time, whatever the batches hold; pieces with other epochs and factors change nothing."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(23):
        epochs = np.linspace(-1, 1, 12 if i % 3 else 9)
        of = [(0.5 + r.random()) * np.cos(3 * epochs), epochs] if i == 7 else [np.cos(3 * epochs), epochs]
        z = np.exp(1j * (of[0] * (i % 4) * (1 + i % 2) + of[1] * 1.5))
        rows.append((i, *[[float(v) for v in x] for x in (z.real, z.imag, *of)], float(1 + i % 2)))
    frame = spark.createDataFrame(rows, "i long, re array<double>, im array<double>, of_demerr array<double>, of_vel array<double>, factor double").coalesce(1)
    sizes, estimate = spark.sparkContext.accumulator(0), unwrapping.estimate

    def seen(z, *rest):
        if len(z) > 4:
            sizes.add(1)
        return estimate(z, *rest)

    monkeypatch.setattr(unwrapping, "ROWS", 4)
    monkeypatch.setattr(unwrapping, "estimate", seen)
    got = {g.i: g for g in unwrapping.search(frame, ["i"], 4.0, 4.0, 20).collect()}
    assert sizes.value == 0 and len(got) == 23
    assert all(abs(got[i].demerr - i % 4) < 1e-6 and abs(got[i].vel - 1.5) < 1e-6 and got[i].gamma > 1 - 1e-9 for i in got)
