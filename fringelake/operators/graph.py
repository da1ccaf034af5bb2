"""Networks of points: components, spanning trees, removal of bad arcs, and integration of arcs to points.

Each is a loop of joins and aggregates over the arcs. Only scalars, such as counts and inner products, reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, scratch
from .pixels import distinct_arcs, nearest, with_lengths


def cut(df: DataFrame) -> DataFrame:
    return scratch(df, "cut")


def _jumped(pointers: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, to, moved) of a table of cut() with every pointer followed to its end; ends point at themselves. A round makes a way four times as long."""
    for _ in range(rounds):
        one = pointers.select(F.col("node").alias("to"), F.col("to").alias("up"))
        two = pointers.join(one, "to").select("node", "to", "up")
        top = two.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = cut(two.join(top, "up").select("node", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
        discard(pointers)
        pointers = after
        if after.where("moved").isEmpty():
            return pointers
    raise RuntimeError(f"pointers did not settle in {rounds} rounds")


def components(points: DataFrame, arcs: DataFrame, rounds: int = 60) -> DataFrame:
    """(point_id, component): the smallest point that each point can reach over arcs (src, dst).

    Each round points every node at its smallest neighbour or itself, follows the pointers to their ends and contracts the
    arcs, so a round leaves at most half of the nodes that still have arcs.
    """
    labels, held = points.select("point_id", F.col("point_id").alias("component")).distinct(), None
    now = cut(arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        if now.isEmpty():
            discard(now)
            return labels
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        lower = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to"))
        ended = _jumped(cut(lower))
        last = ended.select("node", "to")
        after = cut(labels.join(last.withColumnRenamed("node", "component"), "component", "left").select("point_id", F.coalesce("to", "component").alias("component")))
        one, two = (last.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b"))
        fewer = cut(now.join(one, "a").join(two, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        discard(now, ended, held)
        now, labels, held = fewer, after, after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def is_connected(points: DataFrame, arcs: DataFrame) -> bool:
    """Whether every point reaches every other; a table without points is connected."""
    return components(points, arcs).select("component").distinct().limit(2).count() <= 1


def spanning_forest(arcs: DataFrame, rounds: int = 60) -> DataFrame:
    """(src, dst) of the forest of least cost of arcs (src, dst, cost): each round every tree takes its cheapest arc to
    another tree. Equal costs are ordered by their points, so no cycle arises and reruns agree."""
    now = arcs.where("src <> dst").select("src", "dst", F.struct("cost", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).alias("rank"), F.col("src").alias("a"), F.col("dst").alias("b"))
    now, taken = cut(now), []
    for _ in range(rounds):
        if now.isEmpty():
            break
        row = F.struct("rank", "src", "dst", F.col("other"))
        ends = now.select("*", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select("*", F.col("b").alias("node"), F.col("a").alias("other")))
        best = cut(ends.groupBy("node").agg(F.min(row).alias("m")).select("node", F.col("m.other").alias("to"), "m.src", "m.dst"))
        taken.append(best.select("src", "dst"))
        back = best.select(F.col("node").alias("to"), F.col("to").alias("back"))
        # two trees that chose each other: the smaller one is the end of both pointers
        ended = best.join(back, "to").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
        jumped = _jumped(cut(ended))
        one, two = (jumped.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b"))
        rest = now.join(one, "a").join(two, "b").where("to_a <> to_b").select("src", "dst", "rank", F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        # of all arcs between two trees only the cheapest can be taken
        pair = (F.least("a", "b"), F.greatest("a", "b"))
        fewer = cut(rest.groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.min(F.struct("rank", "src", "dst")).alias("m")).select("m.src", "m.dst", "m.rank", "a", "b"))
        discard(now, jumped)
        now = fewer
    else:
        raise RuntimeError(f"the forest did not settle in {rounds} rounds")
    out = arcs.select("src", "dst").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out.distinct()


def without_bad_arcs(arcs: DataFrame, limit: float) -> DataFrame:
    """arcs (src, dst, gamma and more) that reach the limit or belong to the spanning forest of least 1 - gamma, so what
    was connected stays so."""
    kept = spanning_forest(arcs.select("src", "dst", (1 - F.col("gamma")).alias("cost"))).select("src", "dst", F.lit(True).alias("tree"))
    return arcs.join(kept, ["src", "dst"], "left").where((F.col("gamma") >= limit) | F.col("tree")).drop("tree")


def without_bad_points(arcs: DataFrame, limit: float, rounds: int = 100) -> DataFrame:
    """arcs (src, dst, gamma) without those of bad points. The point with the least median of its arcs, of equal ones that of the
    smallest id, goes if the median is under the limit; the medians of the points that it had arcs with are then taken anew,
    with its own arcs still among them, as are those of no point that went before; and so on, until no median is under the limit.

    That order is one of single points, but a removal tells on neighbours only. So first the points are found that might go at
    all: those whose median is under the limit, then those whose median could come under it if, of their neighbours that might go,
    the best went. What hangs together of these points is replayed on its own: other parts do not change it. A task holds one such
    part with its arcs, that is one region of bad points, not the network."""
    one = arcs.where("src <> dst")
    ends = cut(one.select(F.col("src").alias("p"), F.col("dst").alias("q"), "gamma").unionByName(one.select(F.col("dst").alias("p"), F.col("src").alias("q"), "gamma")))

    def reaches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            low = [_least_median(np.asarray(s, float), np.asarray(m, bool)) for s, m in zip(rows["gamma"], rows["may"])]
            yield rows.loc[np.asarray(low) < limit, ["p"]]

    may = ends.select("p").limit(0)
    before, held = 0, None
    for _ in range(rounds):
        known = may.select(F.col("p").alias("q"), F.lit(True).alias("may"))
        seen = ends.join(known, "q", "left").groupBy("p").agg(F.collect_list(F.struct("gamma", F.coalesce("may", F.lit(False)).alias("may"))).alias("e"))
        after = cut(seen.select("p", F.col("e.gamma").alias("gamma"), F.col("e.may").alias("may")).mapInPandas(reaches, "p long"))
        count = after.count()
        discard(held)
        may = held = after
        if count == before:
            break
        before = count
    else:
        raise RuntimeError(f"the bad points were not bounded in {rounds} rounds")
    if not before:
        discard(ends, held)
        return arcs
    of_bad = ends.join(may, "p", "left_semi")
    inner = of_bad.join(may.withColumnRenamed("p", "q"), "q", "left_semi").select(F.col("p").alias("src"), F.col("q").alias("dst"))
    parts = components(may.withColumnRenamed("p", "point_id"), inner)
    rows = of_bad.join(parts.withColumnRenamed("point_id", "p"), "p").select("component", "p", "q", "gamma")
    gone = cut(rows.groupBy("component").applyInPandas(lambda part: pd.DataFrame({"p": _removed(part, limit)}, dtype="int64"), "p long"))
    out = arcs.join(gone.withColumnRenamed("p", "src"), "src", "left_anti").join(gone.withColumnRenamed("p", "dst"), "dst", "left_anti").select(*arcs.columns)
    out = cut(out)
    discard(ends, held, gone)
    return out


def _least_median(gamma: np.ndarray, may: np.ndarray) -> float:
    """The least median of values that is left when some of those that may go, the greatest first, have gone; one value stays."""
    going = np.sort(gamma[may])[::-1]
    low = np.median(gamma)
    rest = gamma[~may]
    for n in range(1, len(going) + (len(rest) > 0)):
        low = min(low, np.median(np.concatenate([rest, going[n:]])))
    return float(low)


def _removed(part: pd.DataFrame, limit: float) -> list[int]:
    """The points p of one part that go, in order, by its rows (p, q, gamma)."""
    arcs: dict[int, dict[int, list[float]]] = {}
    for p, q, g in zip(part["p"].tolist(), part["q"].tolist(), part["gamma"].tolist()):
        arcs.setdefault(p, {}).setdefault(q, []).append(g)
    now = {p: float(np.median([g for x in of.values() for g in x])) for p, of in arcs.items()}
    heap = [(m, p) for p, m in now.items()]
    heapq.heapify(heap)
    out, last = [], {}
    while heap:
        m, p = heapq.heappop(heap)
        if now.get(p) != m:
            continue  # taken anew since, or gone
        if m >= limit:
            break
        del now[p]
        out.append(p)
        for q in arcs[p]:
            if q in now:
                if q in last:  # who went before this one counts no more; this one still does
                    arcs[q].pop(last[q])
                last[q] = p
                new = float(np.median([g for x in arcs[q].values() for g in x]))
                if new != now[q]:
                    now[q] = new
                    heapq.heappush(heap, (new, q))
    return out


def build_arcs(points: DataFrame, k: int, longest: float, radius: float) -> DataFrame:
    """(src, dst, length): arcs between each point (point_id, y, x) and its k nearest others. Arcs longer than `longest` are
    dropped; where the network is then not connected, they come back, and what still is not is connected by the nearest links
    between its parts. `radius` is about the distance of near points."""
    arcs = cut(with_lengths(distinct_arcs(nearest(points, points, k + 1, radius)), points))
    short = arcs.where(F.col("length") <= longest)
    if is_connected(points, short):
        return short
    return reconnected(points, arcs, radius)


def reconnected(points: DataFrame, arcs: DataFrame, radius: float, rounds: int = 60) -> DataFrame:
    """arcs (src, dst, length) and the least links that connect all points (point_id, y, x): each round every part of the network
    takes its shortest link to another part, if it has one that is as near as any link is, in steps of two from the radius on."""
    labels, out, level = components(points, arcs), arcs, 0
    for _ in range(rounds):
        parts = points.join(labels, "point_id").select("point_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "component")
        parts = cut(parts)
        if parts.select("component").distinct().limit(2).count() <= 1:
            discard(parts)
            return out
        near, level = links_between(parts, radius, level)
        links = cut(near)
        merged = components(parts.select(F.col("component").alias("point_id")).distinct(), links.select(F.col("from").alias("src"), F.col("to").alias("dst")))
        labels = cut(parts.select("point_id", "component").join(merged.select(F.col("point_id").alias("component"), F.col("component").alias("to")), "component").select("point_id", F.col("to").alias("component")))
        out = out.unionByName(links.select("src", "dst", F.sqrt("d2").alias("length")).distinct())
        discard(parts)
    raise RuntimeError(f"the network was not connected in {rounds} rounds")


def links_between(parts: DataFrame, radius: float, level: int = 0) -> tuple[DataFrame, int]:
    """((from, to, src, dst, d2), level): the shortest link, of equally short ones that of the smallest ids, from a component to another one
    for points (point_id, y, x, component), for all components that have another one about as near as any has;
    and how often the squares below were doubled, which is where the search may begin when the components have been joined.

    Squares of points double from the radius on until some square has another component within the squares around it. Components
    are then further apart than half a square, so a square sees few of them. Four squares wide, pairs of squares of different
    components hold the shortest links; they are halved step by step, and pairs go whose least distance is above the greatest
    distance of another pair of the same component. So no more points are compared than lie where two components face each other."""
    placed = parts.groupBy("component", "y", "x").agg(F.min("point_id").alias("point_id"))
    placed = cut(placed.withColumn("cy", F.floor(F.col("y") / radius)).withColumn("cx", F.floor(F.col("x") / radius)))
    around = F.expr("transform(sequence(0, 8), n -> struct(n div 3 - 1 as dy, n % 3 - 1 as dx))")

    def squares(level: int) -> DataFrame:
        return placed.select("component", F.shiftright("cy", level).alias("cy"), F.shiftright("cx", level).alias("cx")).distinct()

    def facing(level: int, some: DataFrame | None = None) -> DataFrame:
        one = squares(level) if some is None else squares(level).join(some, "component", "left_semi")
        one = one.select(F.col("component").alias("from"), F.col("cy").alias("ay"), F.col("cx").alias("ax"), F.explode(around).alias("s"))
        one = one.select("from", "ay", "ax", (F.col("ay") + F.col("s.dy")).alias("cy"), (F.col("ax") + F.col("s.dx")).alias("cx"))
        return one.join(squares(level).withColumnRenamed("component", "to"), ["cy", "cx"]).where("from <> to").select("from", "ay", "ax", "to", F.col("cy").alias("by"), F.col("cx").alias("bx"))

    def pruned(pairs: DataFrame) -> DataFrame:
        dy, dx = F.abs(F.col("ay") - F.col("by")), F.abs(F.col("ax") - F.col("bx"))
        least, most = (F.hypot(F.greatest(dy - 1, F.lit(0)), F.greatest(dx - 1, F.lit(0))), F.hypot(dy + 1, dx + 1))
        rows = pairs.withColumn("least", least).withColumn("most", most)
        best = rows.groupBy("from").agg(F.min("most").alias("best"))
        return rows.join(best, "from").where("least <= best").select(*pairs.columns)

    def halves(level: int, side: str) -> DataFrame:
        mine = squares(level)
        name = "from" if side == "a" else "to"
        return mine.select(F.col("component").alias(name), F.shiftright("cy", 1).alias(f"{side}y"), F.shiftright("cx", 1).alias(f"{side}x"), F.col("cy").alias(f"{side}y_"), F.col("cx").alias(f"{side}x_"))

    while (some := cut(facing(level).select(F.col("from").alias("component")).distinct())).isEmpty():
        discard(some)
        level += 1
    pairs = cut(pruned(facing(level + 2, some)))
    for at in range(level + 1, -1, -1):
        finer = pairs.join(halves(at, "a"), ["from", "ay", "ax"]).join(halves(at, "b"), ["to", "by", "bx"])
        finer = cut(pruned(finer.select("from", F.col("ay_").alias("ay"), F.col("ax_").alias("ax"), "to", F.col("by_").alias("by"), F.col("bx_").alias("bx"))))
        discard(pairs)
        pairs = finer
    ends = [placed.select(F.col("component").alias(c), F.col("cy").alias(f"{e}y"), F.col("cx").alias(f"{e}x"), F.col("y").alias(f"y_{e}"), F.col("x").alias(f"x_{e}"), F.col("point_id").alias(e)) for c, e in (("from", "a"), ("to", "b"))]
    near = pairs.join(ends[0], ["from", "ay", "ax"]).join(ends[1], ["to", "by", "bx"])
    d2 = (F.col("y_a") - F.col("y_b")) * (F.col("y_a") - F.col("y_b")) + (F.col("x_a") - F.col("x_b")) * (F.col("x_a") - F.col("x_b"))
    link = F.struct(d2.alias("d2"), F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"), F.col("to").alias("to"))
    return near.groupBy("from").agg(F.min(link).alias("m")).select("from", "m.to", "m.src", "m.dst", "m.d2"), level


def integrate(arcs: DataFrame, reference: int, rounds: int = 500, close: float = 1e-8) -> DataFrame:
    """(point_id, value): the values at points, 0 at the reference, that fit arcs (src, dst, value, weight) with value =
    src - dst best in weighted least squares.

    Preconditioned conjugate gradients on the graph's Laplacian: each round joins the arcs with the search direction and
    sums at their ends. A network that is not connected raises ValueError.
    """
    ends = arcs.select(F.col("src").alias("point_id"), F.col("dst").alias("other"), "value", "weight").unionByName(arcs.select(F.col("dst").alias("point_id"), F.col("src").alias("other"), (-F.col("value")).alias("value"), "weight"))
    ends = cut(ends.where("point_id <> other").select("point_id", "other", F.pow("weight", F.lit(2)).alias("w"), "value"))
    points = ends.select("point_id").distinct()
    if not is_connected(points, ends.select(F.col("point_id").alias("src"), F.col("other").alias("dst"))) or points.where(F.col("point_id") == reference).isEmpty():
        raise ValueError("the network is not connected, or has no reference point")
    free = ends.where(F.col("point_id") != reference)
    now = free.groupBy("point_id").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("value")).alias("r"))
    now = cut(now.select("point_id", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p")))
    inner = free.groupBy("point_id", "other").agg(F.sum("w").alias("w"))
    inner = cut(inner.where(F.col("other") != reference))
    held = None
    size = first = now.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
    for _ in range(rounds):
        if size <= close * close * first:
            break
        there = now.select(F.col("point_id").alias("other"), F.col("p").alias("q"))
        pulled = inner.join(there, "other").groupBy("point_id").agg(F.sum(F.col("w") * F.col("q")).alias("pull"))
        moved = cut(now.join(pulled, "point_id", "left").withColumn("lp", F.col("d") * F.col("p") - F.coalesce("pull", F.lit(0.0))).drop("pull"))
        # one job for what is left now, the step, and what is left after it
        sums = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("size"), F.sum(F.col("p") * F.col("lp")).alias("bend"), F.sum(F.col("r") * F.col("lp") / F.col("d")).alias("cross"), F.sum(F.col("lp") * F.col("lp") / F.col("d")).alias("square")).first()
        size = sums.size
        if size <= close * close * first:
            break
        step = size / sums.bend
        new = max(size - 2 * step * sums.cross + step * step * sums.square, 0.0)
        discard(held)
        held = moved
        after = moved.select("point_id", "d", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("lp")).alias("r"), "p")
        now = after.withColumn("p", F.col("r") / F.col("d") + F.lit(new / size) * F.col("p"))
        size = new
    else:
        raise RuntimeError(f"the integration did not settle in {rounds} rounds")
    return now.select("point_id", F.col("x").alias("value")).unionByName(points.where(F.col("point_id") == reference).select("point_id", F.lit(0.0).alias("value")))
