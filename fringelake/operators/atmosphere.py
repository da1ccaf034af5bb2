"""Atmosphere at points from that at their neighbours: local kriging, linear interpolation and inverse distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, scratch
from .elimination import in_arrays
from .pixels import nearest


def by_distance(near: DataFrame, residuals: DataFrame, power: float = 2.0) -> DataFrame:
    """(point_id, k, phase): mean of the residuals (point_id, k, phase) of the neighbours (a, b, d2), weighted by inverse distance;
    at a neighbour's own place its value."""
    seen = near.select(F.col("a").alias("at"), F.col("b").alias("point_id"), "d2").join(residuals, "point_id")
    weight = F.pow(F.col("d2"), F.lit(-power / 2))
    total = seen.groupBy(F.col("at").alias("point_id"), "k").agg(
        F.avg(F.when(F.col("d2") == 0, F.col("phase"))).alias("own"), F.sum(F.when(F.col("d2") > 0, weight * F.col("phase"))).alias("sum"), F.sum(F.when(F.col("d2") > 0, weight)).alias("weight")
    )
    return total.select("point_id", "k", F.coalesce("own", F.col("sum") / F.col("weight")).alias("phase"))


def krige(near: DataFrame, points: DataFrame, residuals: DataFrame, reach: float, sill: float = 1.0, nugget: float = 0.0) -> DataFrame:
    """(point_id, k, phase) by simple kriging with mean zero from the neighbours (a, b, d2) of each point alone.

    points (point_id, y, x) are the neighbours' places, residuals (point_id, k, phase) their values. The covariance is sill *
    exp(-distance / reach), with the nugget added at distance zero. The weights of a point do not depend on the epoch: one
    small system each, solved for all points of a batch together; the sum over neighbours is a join and an aggregate."""
    places = points.select(F.col("point_id").alias("b"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    around = near.select("a", "b", F.sqrt("d2").alias("d")).join(places, "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "d", "y", "x"))).alias("n"))

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for count, part in rows.groupby(rows["b"].map(len)):
                b, d, y, x = (np.stack([np.asarray(v) for v in part[c]]) for c in ("b", "d", "y", "x"))
                apart = np.hypot(y[:, :, None] - y[:, None, :], x[:, :, None] - x[:, None, :])
                system = sill * np.exp(-apart / reach) + nugget * np.eye(count)
                w = np.linalg.solve(system, (sill * np.exp(-d / reach))[:, :, None])[:, :, 0]
                yield pd.DataFrame({"at": np.repeat(part["a"].to_numpy(), count), "point_id": b.ravel(), "weight": w.ravel()})

    w = around.select("a", "n.b", "n.d", "n.y", "n.x").mapInPandas(weights, "at long, point_id long, weight double")
    return w.join(residuals, "point_id").groupBy(F.col("at").alias("point_id"), "k").agg(F.sum(F.col("weight") * F.col("phase")).alias("phase"))


def krige_fitted(near: DataFrame, points: DataFrame, residuals: DataFrame, models: DataFrame) -> DataFrame:
    """(point_id, k, phase) by simple kriging with mean zero from the neighbours (a, b, d2) of each point alone, with a stable model
    for each epoch: models (k, variance, length, power, nugget), one row for each image. The nugget is the error of the
    values, so they are not met exactly. An epoch without a model gets zeros. points (point_id, y, x) are the neighbours' places,
    residuals (point_id, k, phase) their values, of which each point has all epochs from 0 on.

    A point is one row with the places and arrays of its neighbours; the systems of all points of a batch and all epochs are solved
    together."""
    known = {int(m["k"]): (m["variance"], m["length"], m["power"], m["nugget"]) for m in models.collect()}  # one row for each image
    places = points.select(F.col("point_id").alias("b"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    values = in_arrays(residuals, 1 << 30).select(F.col("point_id").alias("b"), F.col("psi").alias("v"))
    around = near.select("a", "b", F.sqrt("d2").alias("d")).join(places.join(values, "b"), "b")
    rows = around.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "d", "y", "x", "v"))).alias("n")).select("a", *[F.col(f"n.{c}").alias(c) for c in "dyxv"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                part_of = whole.iloc[at : at + 256]
                for count, part in part_of.groupby(part_of["d"].map(len)):
                    d, y, x = (np.stack(part[c].to_numpy()) for c in "dyx")
                    v = np.stack([np.stack(r) for r in part["v"]])
                    apart = np.hypot(y[:, :, None] - y[:, None, :], x[:, :, None] - x[:, None, :])
                    out = np.zeros((len(part), v.shape[2]))
                    for k, (variance, length, power, nugget) in known.items():
                        if variance <= 0 or k >= v.shape[2]:
                            continue  # nothing that varies in space
                        system = variance * np.exp(-((apart / length) ** power)) + (nugget + 1e-9 * variance) * np.eye(count)
                        right = variance * np.exp(-((d / length) ** power))
                        out[:, k] = (np.linalg.solve(system, right[:, :, None])[:, :, 0] * v[:, :, k]).sum(axis=1)
                    yield pd.DataFrame({"point_id": part["a"], "series": list(out)})

    return rows.mapInPandas(run, "point_id long, series array<double>").select("point_id", F.posexplode("series").alias("k", "phase"))


def _turn(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Twice the area of triangles o, p, q: above zero counter-clockwise."""
    return (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])


def hull(places: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of places (n, 2), counter-clockwise."""
    p = np.unique(places, axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out = []
        for r in rows:
            while len(out) > 1 and _turn(out[-2], out[-1], r) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hull_of(points: DataFrame) -> np.ndarray:
    """The corners of the convex hull of points (point_id, y, x): of each batch first, so that only corners travel, which are
    few: of n places spread over an area some log n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((0, 2))
        for b in batches:
            kept = hull(np.concatenate([kept, b[["y", "x"]].to_numpy()]))
        yield pd.DataFrame(kept, columns=["y", "x"])

    rows = points.select(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    return hull(rows.mapInPandas(run, "y double, x double").toPandas().to_numpy().reshape(-1, 2))


def in_hull(places: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Which places are within the corners of hull(), its edges included; none where they have no area."""
    inside = np.full(len(places), len(corners) > 2)
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        inside &= _turn(a, b, places) >= 0
    return inside if len(corners) > 2 else np.zeros(len(places), bool)


def triangles(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, weights, reach) of the Delaunay triangle of p (rows, n, 2) in which each place q (rows, 2) lies: the numbers of
    its corners, -1 for ones that p does not have; the barycentric weights of q; and how far its circumcircle reaches from q.

    Places are lifted to a paraboloid; the triangle is the face under q of the hull of what is lifted. From three corners far away
    around q on, the point most below the plane of the three takes the place of one of them, that which leaves q in the
    triangle, until none is below: each step lowers the plane at q, so no triangle comes twice."""
    rows, n, _ = p.shape
    size = np.maximum(np.abs(p - q[:, None]).max(axis=(1, 2)), 1e-300)
    local = (p - q[:, None]) / size[:, None, None]
    away = 1e4 * np.array([[0.0, 2.0], [-1.7, -1.0], [1.7, -1.0]])
    local = np.concatenate([local, np.broadcast_to(away, (rows, 3, 2))], axis=1)
    height = (local**2).sum(axis=2)
    tri = np.broadcast_to(np.arange(n, n + 3), (rows, 3)).copy()
    todo = np.arange(rows)
    zero = np.zeros(2)

    def plane(r: np.ndarray) -> np.ndarray:
        c, h = local[r[:, None], tri[r]], height[r[:, None], tri[r]]
        return np.linalg.solve(np.concatenate([c, np.ones((len(r), 3, 1))], axis=2), h[:, :, None])[:, :, 0]

    for _ in range(20 * n + 60):
        if not len(todo):
            break
        under = height[todo] - np.einsum("rni,ri->rn", local[todo], (f := plane(todo))[:, :2]) - f[:, 2:]
        np.put_along_axis(under, tri[todo], 0.0, axis=1)
        new = under.argmin(axis=1)
        below = np.take_along_axis(under, new[:, None], axis=1)[:, 0] < -1e-9 * (1 + np.abs(f[:, 2]))
        todo, new = todo[below], new[below]
        if not len(todo):
            break
        took = np.full(len(todo), -np.inf)
        chosen = tri[todo].copy()
        for i in range(3):  # the new point for corner i
            trial = tri[todo].copy()
            trial[:, i] = new
            c = local[todo[:, None], trial]
            area = _turn(c[:, 0], c[:, 1], c[:, 2])
            with np.errstate(all="ignore"):
                least = np.min([_turn(c[:, j], c[:, (j + 1) % 3], zero) / area for j in range(3)], axis=0)
            better = np.isfinite(least) & (least > took)
            took[better], chosen[better] = least[better], trial[better]
        tri[todo] = chosen
    c = local[np.arange(rows)[:, None], tri]
    area = _turn(c[:, 0], c[:, 1], c[:, 2])
    weights = np.stack([_turn(c[:, (j + 1) % 3], c[:, (j + 2) % 3], zero) / area for j in range(3)], axis=1)
    f = plane(np.arange(rows))
    centre = f[:, :2] / 2
    reach = (np.hypot(centre[:, 0], centre[:, 1]) + np.hypot(*(c[:, 0] - centre).T)) * size
    return np.where(tri < n, tri, -1), weights, reach


def linear(targets: DataFrame, points: DataFrame, residuals: DataFrame, radius: float, first: int = 16) -> DataFrame:
    """(point_id, k, phase): the residuals (point_id, k, phase) of points (point_id, y, x), interpolated linearly in the triangles of
    their Delaunay triangulation to targets (point_id, y, x); beyond their hull the nearest point's. `radius` is about the
    distance of near points. Of points at one place the first counts; where four points lie on a circle either diagonal may.

    No triangulation is made as a whole: a target's triangle is found among its nearest points and holds if its circumcircle
    reaches no further than they do, as no other point can then lie in it. Where it reaches further, twice as many points
    are taken, until all are. A target gets three weights, which are joined with the values of all epochs."""
    places = points.groupBy("y", "x").agg(F.min("point_id").alias("point_id"))
    places = scratch(places.select("point_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), "places")
    corners, every = hull_of(places), places.count()
    goals = targets.select("point_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for count, b in whole.groupby(whole["b"].map(len)):
                q = b[["y", "x"]].to_numpy()
                ids, p = np.stack(b["b"].to_numpy()), np.stack([np.stack(b["yb"].to_numpy()), np.stack(b["xb"].to_numpy())], axis=2)
                inside = in_hull(q, corners) & (count > 2)
                tri, weight, reach = np.zeros((len(b), 3), np.int64), np.tile([1.0, 0.0, 0.0], (len(b), 1)), np.zeros(len(b))
                if inside.any():
                    tri[inside], weight[inside], reach[inside] = triangles(q[inside], p[inside])
                far = np.hypot(*(p[:, -1] - q).T)
                lost = (tri < 0).any(axis=1)
                done = ~inside | ~lost & (reach < far) | (count >= every)
                nearest_one = ~inside | lost
                tri[nearest_one], weight[nearest_one] = 0, [1.0, 0.0, 0.0]
                yield pd.DataFrame({"at": b["point_id"], "done": done, "b": list(np.take_along_axis(ids, tri, axis=1)), "w": list(weight)})

    found, k = [], first
    while True:
        # neighbours come in the order of their distance; the nearest is the first
        near = nearest(goals, places, min(k, max(every, 1)), radius).join(places.select(F.col("point_id").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb")), "b")
        rows = near.groupBy(F.col("a").alias("point_id")).agg(F.array_sort(F.collect_list(F.struct("d2", "b", "yb", "xb"))).alias("n"))
        rows = goals.join(rows.select("point_id", *[F.col(f"n.{c}").alias(c) for c in ("b", "yb", "xb")]), "point_id")
        tried = scratch(rows.mapInPandas(run, "at long, done boolean, b array<long>, w array<double>"), "triangles")
        found.append(tried.where("done"))
        rest = tried.where("not done").select(F.col("at").alias("point_id"))
        if rest.isEmpty():
            break
        goals, k = goals.join(rest, "point_id", "left_semi"), 2 * k
    weights = found[0]
    for f in found[1:]:
        weights = weights.unionByName(f)
    w = weights.select("at", F.explode(F.arrays_zip("b", "w")).alias("e")).select("at", F.col("e.b").alias("point_id"), F.col("e.w").alias("w")).where("w <> 0")
    out = w.join(residuals, "point_id").groupBy(F.col("at").alias("point_id"), "k").agg(F.sum(F.col("w") * F.col("phase")).alias("phase"))
    discard(places)
    return out
