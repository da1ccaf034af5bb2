"""Links between the parts of a network against the least spanning tree of all pairs."""

import numpy as np
import pytest

from fringelake.operators import graph


def _points(spark, yx):
    return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(yx)], "point_id long, y double, x double")


def _tree_links(yx, arcs):
    """Kruskal's links between the components of arcs, of all pairs of points."""
    up = list(range(len(yx)))

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in arcs:
        up[find(a)] = find(b)
    pairs = sorted((((yx[i] - yx[j]) ** 2).sum(), i, j) for i in range(len(yx)) for j in range(i))
    out = set()
    for _, i, j in pairs:
        if find(i) != find(j):
            up[find(i)] = find(j)
            out.add((i, j))
    return out


def test_least_links(spark):
    r = np.random.default_rng(1)
    yx = np.round(np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 1, 15), ((40, 3), 4, 12), ((-7, 30), 2, 8), ((5, 5), 0.2, 3))]), 3)
    arcs = [(int(a), int(b)) for a, b in r.integers(0, len(yx), (300, 2)) if a > b and abs(yx[a] - yx[b]).max() < 6]
    frame = spark.createDataFrame([(a, b, float(np.hypot(*(yx[a] - yx[b])))) for a, b in set(arcs)], "src long, dst long, length double")
    got = {(x.src, x.dst) for x in graph.reconnected(_points(spark, yx), frame, 1.0).collect()}
    assert got == set(arcs) | _tree_links(yx, arcs)


@pytest.mark.parametrize("side", [8, 12])
def test_islands_get_one_link(spark, side):
    island = [(y, x) for y in range(side) for x in range(side)]
    yx = [*island, *((y, x + 10 * side) for y, x in island)]
    built = graph.build_arcs(_points(spark, yx), 4, 2.0, 1.5).collect()
    long = [x for x in built if x.length > 2]
    assert len(long) == 1 and len(built) < 6 * len(yx) and (long[0].src, long[0].dst) == (side * side, side - 1)


def test_points_without_arcs_and_repeated_places(spark):
    yx = [(0, 0), (0, 0), (0, 5), (9, 0)]
    got = {(x.src, x.dst) for x in graph.reconnected(_points(spark, yx), spark.createDataFrame([], "src long, dst long, length double"), 1.0).collect()}
    assert got == {(1, 0), (2, 0), (3, 0)}
    assert graph.reconnected(_points(spark, yx[:1]), spark.createDataFrame([], "src long, dst long, length double"), 1.0).count() == 0
