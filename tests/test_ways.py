"""Ways in the image against a plain walk along their vertices; tags and boxes by hand."""

import math

import pytest

from fringelake.operators import ways

LOOKUP = [(y, x, 50 + y * 0.001 + x * 0.0001, 10 + x * 0.001 - y * 0.0001) for y in range(9) for x in range(11)]


def _lookup(spark):
    return spark.createDataFrame(LOOKUP, "y int, x int, lat double, lon double")


def _place(y, x):
    return 50 + y * 0.001 + x * 0.0001, 10 + x * 0.001 - y * 0.0001


def _near(lat, lon):
    d, y, x, la, lo = min((math.hypot(la - lat, lo - lon), y, x, la, lo) for y, x, la, lo in LOOKUP)
    return d, (y, x), (la, lo)


def _border(out, inner, seen_from_inner=False):
    far = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    found = _near(*out)[2]
    cur, prev = (inner, out) if seen_from_inner else (out, inner)
    b, c, a = far(cur, found), far(prev, cur), far(prev, found)
    cosine = (b * b + c * c - a * a) / (2 * b * c)
    t = min(b / cosine / c, 1.0) if cosine > 0 else 1.0
    return _near(*(p + (q - p) * t for p, q in zip(cur, prev)))[1]


def _parts(way, limit):
    """A line's parts, by walking along it."""
    out, now = [], []
    outside = [_near(*p)[0] > limit for p in way]
    for i, p in enumerate(way):
        if not outside[i]:
            if not now and i and outside[i - 1] and not (i > 1 and not outside[i - 2]):
                now.append(_border(way[i - 1], p))
            now.append(_near(*p)[1])
        elif now:
            now.append(_border(p, way[i - 1]))
            out.append(now)
            now = []
    return out + [now] if now else out


def _ring(way, limit):
    way = way if way[0] == way[-1] else [*way, way[0]]
    outside, out = [_near(*p)[0] > limit for p in way], []
    for i, p in enumerate(way):
        if outside[i] and i and not outside[i - 1]:
            out.append(_border(p, way[i - 1]))
        if outside[i] and i + 1 < len(way) and not outside[i + 1]:
            out.append(_border(p, way[i + 1], True))
        if not outside[i]:
            out.append(_near(*p)[1])
    return out


WAYS = {1: [(1.1, 1.2), (4.3, 3.1), (7.7, 9.4)], 2: [(4.1, -6.3), (4.2, 4.4), (4.4, 17.2), (7.2, 16.1), (6.3, 3.2)], 3: [(2.1, 2.2), (-5.2, 4.3), (2.3, 7.1)], 4: [(-9, -9), (-7, 30)], 5: [(-3.2, 5.1), (3.3, 5.2)]}


@pytest.mark.parametrize("closed", [False, True])
def test_ways_are_cut_at_the_image(spark, closed):
    table = spark.createDataFrame([(w, i, *_place(*p)) for w, way in WAYS.items() for i, p in enumerate(way)], "way_id long, seq int, lat double, lon double")
    spacing = ways.pixel_spacing(_lookup(spark))
    d = sorted(math.hypot(a - LOOKUP[0][2], b - LOOKUP[0][3]) for _, _, a, b in LOOKUP)[1:10]
    assert spacing == pytest.approx(sum(d) / 9)
    got = {}
    for r in sorted(ways.in_image(table, _lookup(spark), closed).collect(), key=lambda r: (r.way_id, r.part, r.seq)):
        got.setdefault(r.way_id, {}).setdefault(r.part, []).append((r.y, r.x))
    limit = 1.3 * spacing
    want = {w: ([_ring([_place(*p) for p in way], limit)] if closed else _parts([_place(*p) for p in way], limit)) for w, way in WAYS.items()}
    assert {w: list(p.values()) for w, p in got.items()} == {w: p for w, p in want.items() if p and p[0]}
    if not closed:
        assert len(got[2]) == 2 and len(got[3]) == 2 and 4 not in got  # what leaves and returns gives two


def test_masks(spark):
    square = [(2, 2), (2, 6), (6, 6), (6, 2)]
    table = spark.createDataFrame([(1, i, *_place(*p)) for i, p in enumerate(square)], "way_id long, seq int, lat double, lon double")
    got = {(r.y, r.x) for r in ways.mask(table, _lookup(spark), True).collect()}
    assert {(y, x) for y in range(3, 6) for x in range(3, 6)} | set(square) <= got <= {(y, x) for y in range(2, 7) for x in range(2, 7)}
    got = {(r.y, r.x) for r in ways.mask(table.where("seq < 2"), _lookup(spark), False, 3).collect()}
    assert got == {(y, x) for y in (1, 2, 3) for x in range(2, 7)} | {(2, 1), (2, 7)} | {(y, x) for y in (1, 3) for x in (1, 7) if math.hypot(1, 1) <= 1.5}
    assert {(r.y, r.x) for r in ways.mask(table.where("seq = 0"), _lookup(spark), False).collect()} == {(2, 2)}
    with pytest.raises(ValueError):
        ways.mask(table.where("false"), _lookup(spark), False)


def test_tags(spark):
    nodes = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate([(0, 0), (10, 10), (0, 20), (5, 5), (30, 30), (40, 40)])], "node_id long, lat double, lon double")
    rows = [(1, {"highway": "motorway", "bridge": "yes"}, [0, 1]), (2, {"highway": "track"}, [0, 2]), (3, {"railway": "rail"}, [3]), (4, {"highway": "track", "area": "no"}, [3, 4]), (5, {"highway": "motorway"}, [4, 5]), (6, {"railway": "rail", "bridge": "no"}, [5, 3, 99]), (7, {"bridge": "yes"}, [3]), (8, {}, [3]), (9, {"highway": "motorways", "bridge": "yes"}, [3])]
    table = spark.createDataFrame(rows, "way_id long, tags map<string,string>, refs array<long>")
    box = (4.0, 4.0, 6.0, 6.0)
    ids = lambda df: sorted(r.way_id for r in df.collect())
    assert ids(ways.touching(table, nodes, box)) == [1, 3, 4, 6, 7, 8, 9]  # the first passes through without a node in it
    assert ids(ways.infrastructure(table, nodes, box, ["motorway", "track", "rail"])) == [1, 3, 6]
    assert ids(ways.infrastructure(table, nodes, box, ["rail"])) == [3, 6]
    assert ids(ways.bridges(table, nodes, box)) == [1, 6, 7, 9] and ids(ways.bridges(table, nodes, box, highway=True)) == [1]
    assert ids(ways.bridges(table, nodes, box, railway=True)) == [6] and ids(ways.bridges(table, nodes, box, True, True)) == [1, 6]
    for bad in (lambda: ways.infrastructure(table, nodes, (90.0, 0.0, 91.0, 1.0), ["rail"]), lambda: ways.infrastructure(table, nodes, box, ["path"])):
        with pytest.raises(ValueError):
            bad()
    assert {r.way_id: r.line for r in ways.lines(ways.vertices(table.where("way_id in (1, 6)"), nodes), "line").collect()} == {1: "LINESTRING (0.0 0.0, 10.0 10.0)", 6: "LINESTRING (40.0 40.0, 5.0 5.0)"}
