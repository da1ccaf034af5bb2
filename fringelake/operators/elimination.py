"""Weighted least squares on networks of points by elimination, tile by tile, level by level.

The normal equations of differences along arcs are a network's Laplacian. Points inside of a tile, all of whose arcs stay in
it, are eliminated together; what is left is again the Laplacian of a network, of the tile's border, with new arcs. Four tiles are
joined to one of the next level, and so on, until the reference alone is left; then the values come back, level by level. So the
solution is exact. A task does some levels at once, so the number of jobs grows with the logarithm of the number of points, and
holds one tile's points at first, later the borders of sixteen tiles, which grow with the root of the number of points that they
cover. Factors are not stored: on the way back a task eliminates its tile again, which costs less than to write them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.morton import ranked
from ..scratch import discard, scratch
from . import graph

#: A tile of the first level has 2**TILE points; a tile has no more than FRONT points when it is eliminated.
TILE, FRONT = 6, 8000
#: Further levels that a task does at once: those above the first one, and those above any later one.
NEST, JOIN = 2, 1
#: Numbers in the matrices that a task solves together, and in those that are left of a tile, at most where it can be helped.
TOGETHER, LEFT = 4_000_000, 8_000_000
_ROWS = pa.schema([("part", pa.int32()), ("tile", pa.int64()), ("wrong", pa.string()), ("border", pa.list_(pa.int64())), ("left", pa.list_(pa.float64())), ("rest", pa.list_(pa.float64()))])
_VALUES = pa.schema([("part", pa.int32()), ("node", pa.int64()), ("x", pa.list_(pa.float64()))])


class NotConnected(ValueError):
    """Some point has no way to the reference."""


class TooWide(RuntimeError):
    """A tile has more points with arcs out of it than a task can hold as a matrix."""


class _Wrong(Exception):
    """A tile that cannot be eliminated: front or loose."""


def _front(ids: np.ndarray, outer: np.ndarray, a, b, w, f, blocks, most: int) -> tuple:
    """(g, h, left, rest) of the points ids of which outer stay: g and h give the values of the others from those that stay, left and
    rest are the equations of these. Arcs a, b with w (m, arcs) and f (arcs, m, per); blocks (border, left, rest) of tiles inside."""
    n, m, per = len(ids), *(f.shape[1:] if f is not None else blocks[0][2].shape[1:])
    if n > most:
        raise _Wrong("front")
    inner, border = np.flatnonzero(~outer), np.flatnonzero(outer)
    if len(inner) and not len(border):
        raise _Wrong("loose")
    side, places = np.zeros((n, m, per)), [np.searchsorted(ids, x[0]) for x in blocks]
    for at, (_, _, rest) in zip(places, blocks):
        side[at] += rest
    if f is not None:
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        np.add.at(side, i, f)
        np.add.at(side, j, -f)
    g, h = np.zeros((m, len(inner), len(border))), np.zeros((m, len(inner), per))
    left, rest = np.zeros((m, len(border), len(border))), side[border].transpose(1, 0, 2).copy()
    step = max(1, TOGETHER // n**2)
    for its in (slice(e, min(e + step, m)) for e in range(0, m, step)):
        whole = np.zeros((its.stop - its.start, n, n))
        for at, block in zip(places, blocks):
            whole[:, at[:, None], at] += block[1][its]
        if f is not None:
            # each pair of points has one arc at most
            whole[:, i, j] -= w[its]
            whole[:, j, i] -= w[its]
            own = np.zeros((n, its.stop - its.start))
            np.add.at(own, i, w[its].T)
            np.add.at(own, j, w[its].T)
            whole[:, np.arange(n), np.arange(n)] += own.T
        left[its] = whole[:, border[:, None], border]
        if not len(inner):
            continue
        across = whole[:, inner[:, None], border]
        try:
            both = np.linalg.solve(whole[:, inner[:, None], inner], np.concatenate([across, side[inner][:, its].transpose(1, 0, 2)], axis=2))
        except np.linalg.LinAlgError:
            raise _Wrong("loose") from None
        g[its], h[its] = both[:, :, : len(border)], both[:, :, len(border) :]
        if not np.allclose(g[its].sum(axis=2), -1, atol=1e-4):
            raise _Wrong("loose")
        left[its] -= across.transpose(0, 2, 1) @ g[its]
        rest[its] -= across.transpose(0, 2, 1) @ h[its]
    return g, h, left, rest.transpose(1, 0, 2)


def _dissect(rows: pa.Table, reference: int, shifts: tuple[int, ...], most: int) -> tuple | None:
    """(factors, border, left, rest) of a tile's rows: kind arc (a, b, w, f), border (a), and block, what is left of a tile of the
    level before (border, left, rest). The tile is eliminated by smaller ones, of 2**shift places each, which are joined; factors
    (inner, border, g, h) come in that order. None if there are only arcs out of the tile."""
    kind = np.array(rows["kind"].to_pylist(), dtype=object)
    arcs, held = rows.filter(pa.array(kind == "arc")), rows.filter(pa.array(kind == "block"))
    if not arcs.num_rows and not held.num_rows:
        return None
    a, b = arcs["a"].to_numpy(), arcs["b"].to_numpy()
    outside = np.unique(np.append(rows["a"].filter(pa.array(kind == "border")).to_numpy(), reference))
    flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    w = f = None
    if arcs.num_rows:
        w = np.ascontiguousarray(flat(arcs, "w").reshape(len(a), -1).T)
        f = flat(arcs, "f").reshape(len(a), len(w), -1)
    pending: dict[int, list] = {}
    for border, left, rest in zip(*(held[c] for c in ("border", "left", "rest"))):
        ids = border.values.to_numpy()
        left = left.values.to_numpy().reshape(-1, len(ids), len(ids))
        pending.setdefault(int(ids[0]) >> shifts[0], []).append((ids, left, rest.values.to_numpy().reshape(len(ids), len(left), -1)))
    # the level at which an arc lies in one tile, and the one at which all arcs of a point do
    level = np.zeros(len(a), dtype=np.int64)
    for i, s in enumerate(shifts):
        level[(a >> s) != (b >> s)] = i + 1
    nodes = np.unique(np.concatenate([a, b, *[x[0] for blocks in pending.values() for x in blocks]]))
    last = np.zeros(len(nodes), dtype=np.int64)
    for end in (a, b):
        np.maximum.at(last, np.searchsorted(nodes, end), level)
    last[np.isin(nodes, outside)] = len(shifts)
    factors = []
    for i, s in enumerate(shifts):
        at = np.flatnonzero(level == i)
        tiles = a[at] >> s
        order = np.argsort(tiles, kind="stable")
        at, tiles = at[order], tiles[order]
        joined: dict[int, list] = {}
        for t in sorted({*pending, *np.unique(tiles).tolist()}):
            its = at[np.searchsorted(tiles, t) : np.searchsorted(tiles, t, side="right")]
            blocks = pending.get(t, [])
            ids = np.unique(np.concatenate([a[its], b[its], *[x[0] for x in blocks]]))
            outer = last[np.searchsorted(nodes, ids)] > i
            g, h, left, rest = _front(ids, outer, a[its], b[its], *((w[:, its], f[its]) if len(its) else (None, None)), blocks, most)
            factors.append((ids[~outer], ids[outer], g, h))
            if outer.any():
                joined.setdefault(t >> (shifts[i + 1] - s if i + 1 < len(shifts) else 0), []).append((ids[outer], left, rest))
        pending = joined
    (found,) = [x for blocks in pending.values() for x in blocks]
    return factors, *found


def _eliminate(reference: int, shifts: tuple[int, ...], most: int):
    def run(rows: pa.Table) -> pa.Table:
        part, tile, wrong, found = rows["part"][0].as_py(), rows["tile"][0].as_py(), None, None
        try:
            found = _dissect(rows, reference, shifts, most)
        except _Wrong as e:
            wrong = str(e)
        if found is None and wrong is None:
            return _ROWS.empty_table()
        _, border, left, rest = found or (None, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel()))
        return pa.table([pa.array([part], pa.int32()), pa.array([tile], pa.int64()), pa.array([wrong], pa.string()), one(border), one(left), one(rest)], schema=_ROWS)

    return run


def _back(reference: int, shifts: tuple[int, ...], most: int):
    """The values of the points inside of tiles from those of their borders."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        found = _dissect(rows, reference, shifts, most) if known.num_rows and rows.num_rows else None
        if found is None:
            return _VALUES.empty_table()
        factors, border, left, _ = found
        of, m = {n: x for n, x in zip(known["node"].to_pylist(), known["x"].to_pylist())}, len(left)
        nodes = np.concatenate([border, *[inner for inner, *_ in factors]])
        order = np.argsort(nodes)
        nodes = nodes[order]
        x = np.zeros((m, len(nodes), len(of[int(border[0])]) // m))
        x[:, np.searchsorted(nodes, border)] = np.array([of[int(p)] for p in border]).reshape(len(border), m, -1).transpose(1, 0, 2)
        for inner, outer, g, h in reversed(factors):
            x[:, np.searchsorted(nodes, inner)] = h - g @ x[:, np.searchsorted(nodes, outer)]
        new = np.isin(nodes, border, invert=True)
        nodes, values = nodes[new], x[:, new].transpose(1, 0, 2).reshape(new.sum(), x.shape[0] * x.shape[2])
        ends = pa.array(np.arange(len(nodes) + 1) * values.shape[1], pa.int32())
        return pa.table([pa.array(np.full(len(nodes), rows["part"][0].as_py(), np.int32)), pa.array(nodes), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], schema=_VALUES)

    return run


def _steps(last: int) -> list[tuple[int, ...]]:
    """The shifts of the levels that each job does, for points with ranks up to `last`."""
    out, shift = [], TILE
    while not out or last >> out[-1][-1]:
        out.append(tuple(range(shift, shift + 2 * (JOIN if out else NEST) + 1, 2)))
        shift = out[-1][-1] + 2
    return out


def _widest(pairs: DataFrame, last: int) -> int:
    """The largest number of points with arcs out of a tile at the end of a job, for pairs (a, b) of ranks."""
    shifts = F.array(*[F.lit(s[-1]) for s in _steps(last)])
    tile = lambda end: F.expr(f"shiftright({end}, s)")
    across = pairs.select("a", "b", F.explode(shifts).alias("s")).where(tile("a") != tile("b"))
    ends = across.select("s", F.col("a").alias("node")).unionByName(across.select("s", F.col("b").alias("node"))).distinct()
    return ends.groupBy("s", tile("node").alias("tile")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def solve(arcs: DataFrame, last: int, reference: int) -> DataFrame:
    """(part, node, x): for each part the arrays x at nodes, zero at the reference, that fit the arcs (part, a, b, w, f) best: the sum
    over arcs of w * (x_a - x_b - f / w) ** 2 is least. w has a weight for each element of x, or one for all; f is weight times
    difference. Nodes are the ranks of points, up to `last`, in an order in which near ones are near, as functions.morton.ranked()
    gives it. The arcs of all parts are the same, a table that can be read again, and each pair of nodes has one at most.

    Nodes that have no way to the reference raise NotConnected. A tile of more than FRONT nodes at its turn, as networks of more
    than some 250 000 points in a square or with many long arcs give, raises TooWide."""
    steps, levels, inputs = _steps(last), [], []
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    doubles, longs = "array<double>", "array<long>"
    for n, shifts in enumerate(steps):
        tile = lambda end, s=shifts[-1]: F.shiftright(end, s)
        new = tile("a") == tile("b")
        if n:
            new = new & (F.shiftright("a", steps[n - 1][-1]) != F.shiftright("b", steps[n - 1][-1]))
        rows = arcs.where(new).select("part", tile("a").alias("tile"), F.lit("arc").alias("kind"), "a", "b", "w", "f", none(longs, "border"), none(doubles, "left"), none(doubles, "rest"))
        crossing = arcs.where(tile("a") != tile("b"))
        ends = crossing.select("part", "a").unionByName(crossing.select("part", F.col("b").alias("a"))).distinct()
        rows = rows.unionByName(ends.select("part", tile("a").alias("tile"), F.lit("border").alias("kind"), "a", none("long", "b"), none(doubles, "w"), none(doubles, "f"), none(longs, "border"), none(doubles, "left"), none(doubles, "rest")))
        if levels:
            before = levels[-1].where("size(border) > 0")
            up = F.shiftright("tile", shifts[-1] - steps[n - 1][-1])
            rows = rows.unionByName(before.select("part", up.alias("tile"), F.lit("block").alias("kind"), none("long", "a"), none("long", "b"), none(doubles, "w"), none(doubles, "f"), "border", "left", "rest"))
        inputs.append(rows)
        levels.append(scratch(rows.groupBy("part", "tile").applyInArrow(_eliminate(reference, shifts, FRONT), "part int, tile long, wrong string, border array<long>, left array<double>, rest array<double>"), "level"))
    wrong = functools.reduce(DataFrame.unionByName, [level.where("wrong is not null").select("wrong") for level in levels]).agg(F.min("wrong")).first()[0]  # front before loose
    if wrong is not None:
        discard(*levels)
        if wrong == "front":
            raise TooWide(f"a tile has more than {FRONT} points with arcs out of it: the network has too many long arcs")
        raise NotConnected("the network is not connected, or has no reference point")
    out = [levels[-1].select("part", F.lit(reference).cast("long").alias("node"), F.transform("rest", lambda v: F.lit(0.0)).alias("x"))]
    for shifts, rows, level in reversed(list(zip(steps, inputs, levels))):
        known = functools.reduce(DataFrame.unionByName, out)
        wanted = level.select("part", "tile", F.explode("border").alias("node")).join(known, ["part", "node"])
        both = rows.groupBy("part", "tile").cogroup(wanted.groupBy("part", "tile"))
        out.append(scratch(both.applyInArrow(_back(reference, shifts, FRONT), "part int, node long, x array<double>"), "values"))
    out[0] = scratch(out[0], "values")
    discard(*levels)
    return functools.reduce(DataFrame.unionByName, out)


def _rank_of(ranks: DataFrame, point: int) -> int:
    row = ranks.where(F.col("point_id") == point).select("rank").first()
    if row is None:
        raise NotConnected("the network has no reference point")
    return row[0]


def _in_ranks(arcs: DataFrame, ranks: DataFrame) -> DataFrame:
    """arcs (src, dst and more) with the ranks of their ends, a and b, in place of them."""
    one, two = (ranks.select(F.col("point_id").alias(e), F.col("rank").alias(r)) for e, r in (("src", "a"), ("dst", "b")))
    return arcs.join(one, "src").join(two, "dst").drop("src", "dst")


def integrate(arcs: DataFrame, places: DataFrame, reference: int, values: list[str]) -> DataFrame:
    """(point_id, values...): each value at points, 0 at the reference, that fits arcs (src, dst, values..., weight) with value = src -
    dst best in least squares of weight times difference. All values are solved together, as the weights are the same. Several
    arcs between two points count as one with the sum of their weights. places (point_id, y, x) are where points are. A network
    that is too wide for elimination is solved by conjugate gradients, one value after the other."""
    square = F.pow("weight", F.lit(2))
    lo, hi, sign = F.least("src", "dst"), F.greatest("src", "dst"), F.when(F.col("src") < F.col("dst"), 1).otherwise(-1)
    one = arcs.where("src <> dst").groupBy(lo.alias("src"), hi.alias("dst")).agg(F.sum(square).alias("w"), *[F.sum(square * sign * F.col(v)).alias(v) for v in values])
    rows = one.select(F.lit(0).alias("part"), "src", "dst", F.array("w").alias("w"), F.array(*values).alias("f"))
    ranks = ranked(places)
    last, node = ranks.agg(F.max("rank")).first()[0] or 0, _rank_of(ranks, reference)
    arcs_at = scratch(_in_ranks(rows, ranks), "arcs")
    try:
        x = solve(arcs_at, last, node).withColumnRenamed("node", "rank").join(ranks, "rank")
    except TooWide:
        found = [graph.integrate(arcs.select("src", "dst", F.col(v).alias("value"), "weight"), reference).withColumnRenamed("value", v) for v in values]
        return functools.reduce(lambda a, b: a.join(b, "point_id"), found)
    out = scratch(x.select("point_id", *[F.col("x")[i].alias(v) for i, v in enumerate(values)]), "integrated")
    discard(ranks, arcs_at)
    return out


def _chunk(k: Column, size: int) -> Column:
    return F.floor(k / size).cast("int")


def in_arrays(phases: DataFrame, size: int) -> DataFrame:
    """(point_id, part, psi): `size` epochs of phases (point_id, k, phase) after each other in one array; all points have all epochs."""
    return phases.groupBy("point_id", _chunk(F.col("k"), size).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "phase"))), lambda e: e["phase"]).alias("psi"))


def unwrap(phases: DataFrame, arcs: DataFrame, places: DataFrame, reference: int, power: float = 0.4, rounds: int = 6, size: int | None = None) -> DataFrame:
    """(point_id, k, phase): wrapped phases (point_id, k, phase) of points in all interferograms k, unwrapped in space along arcs (src,
    dst), with the mean of each interferogram taken off.

    The differences along arcs, wrapped, are those of the unwrapped phase but on some arcs, and these are to be few: the sum
    of |difference - wrapped difference| ** power is made small by least squares whose weights come from the last solution, with a
    floor that is lowered from round to round. All interferograms are solved together, each with weights of its own, in arrays of
    `size`, which changes nothing but what a task holds: sixteen, or fewer where tiles have long borders. At last each point's phase gets the whole cycles that bring it nearest to the solution; so differences around any loop
    of arcs sum up to zero, and the phase stays what it was up to whole cycles and the mean. NotConnected as in solve()."""
    some = phases.where("phase is not null")
    ranks = ranked(places.join(some.select("point_id").distinct(), "point_id", "left_semi"))
    last, node = ranks.agg(F.max("rank")).first()[0] or 0, _rank_of(ranks, reference)
    pairs = scratch(_in_ranks(arcs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), ranks), "pairs")
    size = size or max(1, min(16, LEFT // max(1, _widest(pairs, last)) ** 2))
    psi = scratch(in_arrays(some, size).join(ranks, "point_id").drop("point_id").withColumnRenamed("rank", "node"), "psi")
    ends = [psi.select(F.col("node").alias(e), "part", F.col("psi").alias(f"psi_{e}")) for e in ("a", "b")]
    turn = lambda a, b: F.atan2(F.sin(a - b), F.cos(a - b))
    steps = scratch(pairs.join(ends[0], "a").join(ends[1], ["b", "part"]).select("part", "a", "b", F.zip_with("psi_a", "psi_b", turn).alias("g")), "steps")
    weighed, x = steps.withColumn("w", F.transform("g", lambda _: F.lit(1.0))), None
    for n in range(rounds):
        if x is not None:
            floor = 0.5 ** (n - 1)  # radians
            one, two = (x.select("part", F.col("node").alias(e), F.col("x").alias(f"x_{e}")) for e in ("a", "b"))
            off = F.zip_with(F.zip_with("x_a", "x_b", lambda a, b: a - b), "g", lambda d, g: d - g)
            weight = F.transform(off, lambda d: F.pow(d * d + floor * floor, F.lit((power - 2) / 2)))
            weighed = steps.join(one, ["part", "a"]).join(two, ["part", "b"]).select("part", "a", "b", "g", weight.alias("w"))
        now = scratch(weighed.select("part", "a", "b", "w", F.zip_with("w", "g", lambda w, g: w * g).alias("f")), "weighed")
        x = solve(now, last, node)
        discard(now)
    first = psi.where(F.col("node") == node).select("part", F.col("psi").alias("base"))
    # one row for each array of epochs
    both = psi.join(x, ["part", "node"]).join(F.broadcast(first), "part").join(ranks.withColumnRenamed("rank", "node"), "node")
    cycles = F.zip_with(F.zip_with("psi", "base", lambda p, b: p - b), "x", lambda p, v: F.round((v - p) / (2 * np.pi)))
    whole = both.select("point_id", "part", F.posexplode(F.zip_with("psi", cycles, lambda p, n: p + 2 * np.pi * n)).alias("i", "phase"))
    rows = scratch(whole.select("point_id", (F.col("part") * size + F.col("i")).cast("int").alias("k"), "phase"), "unwrapped")
    mean = rows.groupBy("k").agg(F.avg("phase").alias("mean"))
    out = rows.join(F.broadcast(mean), "k").select("point_id", "k", (F.col("phase") - F.col("mean")).alias("phase"))  # one row for each interferogram
    discard(psi, steps, pairs, ranks)
    return out
