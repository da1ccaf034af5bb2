"""Operators on rasters and points: coherence, selection, windows, neighbours."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phase import circular_coherence, wrap
from ..scratch import scratch


def arc_observations(phases: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, dst, k, phase): wrapped phase differences of arcs (src, dst)."""
    s = phases.select(F.col("point_id").alias("src"), "k", F.col("phase").alias("a"))
    d = phases.select(F.col("point_id").alias("dst"), "k", F.col("phase").alias("b"))
    return arcs.join(s, "src").join(d, ["dst", "k"]).select("src", "dst", "k", wrap(F.col("a") - F.col("b")).alias("phase"))


def coherence(phases: DataFrame, *by: str) -> DataFrame:
    return phases.groupBy(*by).agg(circular_coherence(F.col("phase")).alias("gamma"))


def at_least(rows: DataFrame, column: str, limit: float) -> DataFrame:
    """Rows whose value reaches the limit; NaN does not."""
    return rows.where(~F.isnan(column) & (F.col(column) >= limit))


def best_in_cell(rows: DataFrame, quality: str, cell: int, largest: bool = True) -> DataFrame:
    """The best point of each square of `cell` pixels, the first in row order of equal ones; a square with a NaN has none."""
    squares = rows.withColumn("cy", F.floor(F.col("y") / cell)).withColumn("cx", F.floor(F.col("x") / cell))
    w = Window.partitionBy("cy", "cx")
    order = (F.desc if largest else F.asc)(F.round(F.col(quality), 9))
    ranked = squares.withColumn("bad", F.max(F.isnan(quality)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(order, "y", "x")))
    return ranked.where("rank = 1 and not bad").drop("rank", "bad")


def interferograms(pixels: DataFrame, network: DataFrame) -> DataFrame:
    """(point_id, first, second, re, im): first image times the conjugate of the second, for pixels (point_id, img, re, im)."""
    one = pixels.select("point_id", F.col("img").alias("first"), F.col("re").alias("ra"), F.col("im").alias("ia"))
    two = pixels.select("point_id", F.col("img").alias("second"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    both = one.join(F.broadcast(network.select("first", "second")), "first").join(two, ["point_id", "second"])
    return both.select("point_id", "first", "second", F.expr("ra * rb + ia * ib").alias("re"), F.expr("ia * rb - ra * ib").alias("im"))


def mean_amplitude(pixels: DataFrame) -> DataFrame:
    """(point_id, bmap): log10 of the mean amplitude; null where it is 0."""
    mean = F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    return pixels.groupBy("point_id").agg(F.log10(F.nullif(mean, F.lit(0.0))).alias("bmap"))


def box_sums(rows: DataFrame, values: list[str], half: int, height: int, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., y, x, each value, each value_around): sums over the square of 2 * half + 1 pixels around each pixel without the
    pixel itself; beyond an edge the image is mirrored, edge pixel included. A pixel goes to the rows and then to the columns
    that it counts for, so sums are pre-aggregated and no row of the image has to fit into one task."""

    def places(at: str, n: int) -> Column:
        # the pixel and its images beyond the edges, each with the pixels around it
        c, none = F.col(at).cast("int"), F.array().cast("array<int>")
        around = lambda p: F.sequence(F.greatest(p - half, F.lit(0)), F.least(p + half, F.lit(n - 1)))
        return F.explode(F.concat(around(c), F.when(c < half, around(-1 - c)).otherwise(none), F.when(c >= n - half, around(2 * n - 1 - c)).otherwise(none)))

    along = rows.select(*by, "y", places("x", width).alias("cx"), *values).groupBy(*by, "y", "cx").agg(*[F.sum(v).alias(v) for v in values])
    sums = along.select(*by, "cx", places("y", height).alias("cy"), *[F.col(v).alias(f"{v}_around") for v in values], *[F.lit(None).cast("double").alias(v) for v in values])
    own = rows.select(*by, F.col("x").cast("int").alias("cx"), F.col("y").cast("int").alias("cy"), *[F.lit(None).cast("double").alias(f"{v}_around") for v in values], *[F.col(v).cast("double").alias(v) for v in values])
    both = sums.unionByName(own).groupBy(*by, F.col("cy").alias("y"), F.col("cx").alias("x")).agg(*[F.sum(x).alias(x) for v in values for x in (v, f"{v}_around")], F.count(values[0]).alias("here"))
    return both.where("here > 0").select(*by, "y", "x", *values, *[(F.col(f"{v}_around") - F.col(v)).alias(f"{v}_around") for v in values])


def box_sum(rows: DataFrame, value: str, half: int, height: int, width: int) -> DataFrame:
    """(y, x, total): box_sums() of one value of one image."""
    return box_sums(rows, [value], half, height, width).select("y", "x", F.col(f"{value}_around").alias("total"))


def temporal_coherence(ifgs: DataFrame, points: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """(y, x, gamma): temporal phase coherence of each pixel, from interferograms (point_id, first, second, re, im) and points
    (point_id, y, x): the phase of each is compared with that of the sum of the pixels around it in the same interferogram,
    and gamma is the length of the mean unit vector of the differences. A zero has the phase zero."""
    rows = ifgs.join(points.select("point_id", "y", "x"), "point_id")
    s = box_sums(rows, ["re", "im"], half, height, width, ("first", "second"))
    angle = F.atan2(F.expr("im * re_around - re * im_around"), F.expr("re * re_around + im * im_around"))
    return s.select("y", "x", angle.alias("phase")).groupBy("y", "x").agg(circular_coherence(F.col("phase")).alias("gamma"))


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(a, b, d2): pairs at most `radius` apart, by an equi-join on squares of that size and their neighbours."""
    r = max(radius, 1e-9)
    cell = lambda c: F.floor(F.col(c) / r)
    around = F.expr("transform(sequence(0, 8), n -> struct(n div 3 - 1 as dy, n % 3 - 1 as dx))")
    a = points.select(F.col("point_id").alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa"), F.explode(around).alias("s"))
    a = a.select("a", "ya", "xa", (cell("ya") + F.col("s.dy")).alias("cy"), (cell("xa") + F.col("s.dx")).alias("cx"))
    b = others.select(F.col("point_id").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"), cell("y").alias("cy"), cell("x").alias("cx"))
    d2 = (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")) + (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb"))
    return a.join(b, ["cy", "cx"]).select("a", "b", d2.cast("double").alias("d2")).where(F.col("d2") <= radius * radius)


def nearest(points: DataFrame, others: DataFrame, k: int, radius: float) -> DataFrame:
    """(a, b, d2, rank): the k nearest others of each point, itself included if it is among them; of equally near ones the
    smaller id. They are looked for within radius, and where that is not enough, within twice as much, and so on, so no
    point gets less than k unless there are less others. Near points are searched by equi-joins on squares; a square that
    holds very many is split by Spark's skew join."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))
    rest, parts, enough = points, [], min(k, others.count())
    while enough:
        found = scratch(within(rest, others, radius).withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
        done = found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("a")
        rest = rest.join(done, rest.point_id == done.a, "left_anti")
        parts.append(found.join(done, "a", "left_semi"))
        if rest.isEmpty():
            break
        radius *= 2
    out = within(points, others, radius).withColumn("rank", rank).limit(0) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def annulus(near: DataFrame, least: float, most: float | None = None) -> DataFrame:
    """Neighbours (a, b, d2) further than `least`, nearer than `most`, and not at the point itself."""
    far = (F.sqrt("d2") > least) & (F.col("d2") != 0)
    return near.where(far if most is None else far & (F.sqrt("d2") < most))


def with_lengths(arcs: DataFrame, points: DataFrame) -> DataFrame:
    """arcs (src, dst) with length, the distance of their points (point_id, y, x)."""
    one, two = (points.select(F.col("point_id").alias(e), F.col("y").alias(f"y_{e}"), F.col("x").alias(f"x_{e}")) for e in ("src", "dst"))
    length = F.hypot(F.col("y_src") - F.col("y_dst"), F.col("x_src") - F.col("x_dst"))
    return arcs.join(one, "src").join(two, "dst").withColumn("length", length).drop("y_src", "x_src", "y_dst", "x_dst")


def nearest_pixel(targets: DataFrame, pixels: DataFrame, radius: float) -> DataFrame:
    """(target, point_id, d2): the pixel (point_id, y, x) nearest to each target (point_id, y, x); of equally near ones the first."""
    return nearest(targets, pixels, 1, radius).select(F.col("a").alias("target"), F.col("b").alias("point_id"), "d2")


def valid(rows: DataFrame, amplitude: str) -> DataFrame:
    """Rows whose mean amplitude (log10, null or NaN where it was zero) is that of a valid pixel."""
    return rows.where(F.col(amplitude).isNotNull() & ~F.isnan(amplitude) & (F.pow(F.lit(10.0), F.col(amplitude) / 10) > 0))


def second_order(rows: DataFrame, coherence: str, limit: float, siblings: str, fewest: int, persistent: str | None = None) -> DataFrame:
    """Candidates of second order by the coherence of phase linking: above the limit, or persistent where such a column is
    given; where none is, those with no more than `fewest` siblings are dropped. NaN is not above a limit."""
    above = ~F.isnan(coherence) & (F.col(coherence) > limit)
    return rows.where(above | F.col(persistent) if persistent else above & (F.col(siblings) > fewest))


def extent(rows: DataFrame) -> DataFrame:
    """One row: least and largest lat and lon without NaN, and the lat and lon of the four corners of the image (y, x)."""
    fine = ~F.isnan("lat") & ~F.isnan("lon")
    box = [f(F.when(fine, F.col(c))).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))]
    corners = {"upper_left": (F.min, 1), "upper_right": (F.min, -1), "lower_left": (F.max, -1), "lower_right": (F.max, 1)}
    at = [f(F.struct(F.col("y"), s * F.col("x"), "lat", "lon")).alias(k) for k, (f, s) in corners.items()]
    out = rows.agg(*box, *at)
    return out.select("min_lat", "max_lat", "min_lon", "max_lon", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in corners for c in ("lat", "lon")])


def distinct_arcs(pairs: DataFrame) -> DataFrame:
    """(src, dst) with src > dst, each once."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()


def edges_of(vertices: DataFrame, closed: bool) -> DataFrame:
    """(way_id, y1, x1, y2, x2): edges of ways (way_id, seq, y, x) from each vertex to the next; a closed way ends where it began."""
    w = Window.partitionBy("way_id").orderBy("seq")
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)) if closed else F.lead(c).over(w)
    return vertices.select("way_id", F.col("y").alias("y1"), F.col("x").alias("x1"), following("y").alias("y2"), following("x").alias("x2")).where("y2 is not null")


def _on_rows(edges: DataFrame, first: Column, last: Column) -> DataFrame:
    """An edge for each row of pixels from first to last."""
    rows = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return edges.withColumn("y", F.explode(rows))


def in_polygons(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """points (point_id, y, x; y whole) inside of any polygon of a table of vertices (way_id, seq, y, x), by the even-odd rule. Edges
    are joined with the rows of pixels that they cross, so no pixel meets an edge far from it."""
    e = edges_of(vertices, True)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = _on_rows(e.where("y1 <> y2"), F.ceil(low), F.ceil(high) - 1)
    right = F.col("x") < F.col("x1") + (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) * (F.col("y") - F.col("y1"))
    crossed = points.select("point_id", "y", "x").join(e, "y").where(right).groupBy("way_id", "point_id").agg(F.count(F.lit(1)).alias("n"))
    return points.join(crossed.where("n % 2 = 1").select("point_id").distinct(), "point_id", "left_semi")


def consistency(phases: DataFrame, pairs: DataFrame, wavelength: float) -> DataFrame:
    """(point_id, consistency in metres): the least root mean square, over neighbours (a, b), of the differences of steps
    between epochs."""
    w = Window.partitionBy("point_id").orderBy("k")
    steps = phases.withColumn("step", F.col("phase") - F.lag("phase").over(w)).where("step is not null").select("point_id", "k", "step")
    a = steps.select(F.col("point_id").alias("a"), "k", F.col("step").alias("sa"))
    b = steps.select(F.col("point_id").alias("b"), "k", F.col("step").alias("sb"))
    rms = pairs.select("a", "b").join(a, "a").join(b, ["b", "k"]).groupBy("a", "b").agg(F.sqrt(F.sum((F.col("sa") - F.col("sb")) * (F.col("sa") - F.col("sb"))) / F.count(F.lit(1))).alias("rms"))
    return rms.groupBy(F.col("a").alias("point_id")).agg((F.min("rms") * wavelength / (4 * 3.141592653589793)).alias("consistency"))


def spatiotemporal_consistency(phases: DataFrame, places: DataFrame, wavelength: float, k: int = 50, least: float = 15.0, most: float | None = None, radius: float = 30.0) -> DataFrame:
    """(point_id, consistency in metres) of points (point_id, y, x in metres) against those of their k nearest, themselves counted, that are
    further than `least` and nearer than `most`; no row for a point that has none. radius is about the distance of near points."""
    return consistency(phases, annulus(nearest(places, places, k, radius), least, most), wavelength)


def box_edges(size: int, boxes: int) -> list[int]:
    """Edges of about `boxes` boxes along one axis; a rest of less than half a box goes to the last one."""
    step, edges = max(size // boxes, 1), [0]
    while edges[-1] < size:
        following = edges[-1] + step
        edges.append(size if following + round(step / 2) > size else following)
    return edges


def metric_edges(height: int, width: int, length_m: float, width_m: float, size: float) -> tuple[list[int], list[int]]:
    """Edges of rows and columns of boxes of about `size` metres; length_m and width_m lie between the corner pixels. Half a
    box counts to the even number, and there is one box at least; a size that is not positive raises ValueError."""
    if not size > 0:
        raise ValueError("the size of a box must be positive")
    return box_edges(height, max(1, round(length_m / size))), box_edges(width, max(1, round(width_m / size)))


def boxed(points: DataFrame, rows: list[int], columns: list[int]) -> DataFrame:
    """points with box_y and box_x, the numbers of the boxes between the edges; null outside of all. Edges are searched by
    bisection, so a point costs the logarithm of their number."""

    def numbered(df: DataFrame, at: str, edges: list[int], out: str) -> DataFrame:
        found = Bucketizer(splits=[float(e) for e in edges] + [float("inf")], inputCol=at, outputCol=out, handleInvalid="keep").transform(df)
        return found.withColumn(out, F.when((F.col(at) >= edges[0]) & (F.col(at) < edges[-1]), F.col(out).cast("int")))

    return numbered(numbered(points, "y", rows, "box_y"), "x", columns, "box_x")


def along_ways(points: DataFrame, vertices: DataFrame, half: float) -> DataFrame:
    """points (point_id, y, x; y whole) at most `half` pixels from a way of a table of vertices (way_id, seq, y, x). Segments are
    joined with the rows of pixels that they come near."""
    e = edges_of(vertices, False)
    e = _on_rows(e, F.ceil(F.least("y1", "y2") - half), F.floor(F.greatest("y1", "y2") + half))
    p = points.select("point_id", "y", "x").join(e, "y")
    dy, dx = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    along = ((F.col("y") - F.col("y1")) * dy + (F.col("x") - F.col("x1")) * dx) / F.nullif(dy * dy + dx * dx, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    off_y, off_x = F.col("y") - F.col("y1") - t * dy, F.col("x") - F.col("x1") - t * dx
    near = p.where(off_y * off_y + off_x * off_x <= half * half)
    return points.join(near.select("point_id").distinct(), "point_id", "left_semi")


def wide(rows: DataFrame, value: str, epochs: list[str]) -> DataFrame:
    """(point_id, one column for each epoch) from rows (point_id, epoch, value): the form of an export. The names are given,
    so no job looks for them."""
    return rows.groupBy("point_id").pivot("epoch", epochs).agg(F.first(value))
