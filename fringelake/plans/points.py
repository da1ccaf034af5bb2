"""Further queries: temporal phase coherence, arcs, candidates, references, removal of models, places, atmosphere and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phase import wrap
from ..functions.projection import utm, utm_sql
from ..operators import atmosphere as atm
from ..operators import estimation as est
from ..operators import graph
from ..operators import network as net
from ..operators import pixels as px
from ..sources import tables as src
from .catalog import _ACQ, _COH, _FIRST, _PP, _PT, _PX, LAMBDA, QUERIES, _add, _chain, _first_order, _height, _near, _r
from .networks import _BASE, _TIME, _arc_gamma, _box_sql

_HALF = 2
_MIRROR = "mi AS (SELECT pt.y, pt.x, CASE WHEN y + dy < 0 THEN -1 - y - dy WHEN y + dy >= h THEN 2 * h - 1 - y - dy ELSE y + dy END AS ry, CASE WHEN x + dx < 0 THEN -1 - x - dx WHEN x + dx >= 25 THEN 49 - x - dx ELSE x + dx END AS rx FROM pt, (SELECT max(y) + 1 AS h FROM pt), range(-2, 3) AS i(dy), range(-2, 3) AS j(dx) WHERE dy <> 0 OR dx <> 0)"


def _knn(name: str, k: int, others: str = "TRUE") -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.point_id AS a, b.point_id AS b, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2)::DOUBLE AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.point_id) AS rank FROM pt a, pt b WHERE {others}) WHERE rank <= {k})"


@_add(f"WITH {_PX}, {_PT}, {_MIRROR}, ifg AS (SELECT y, x, a.img AS first, b.img AS second, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM px a JOIN px b ON a.point_id = b.point_id AND b.img - a.img BETWEEN 1 AND 2 JOIN pt ON pt.point_id = a.point_id), t AS (SELECT mi.y, mi.x, first, second, sum(re) AS re, sum(im) AS im FROM mi JOIN ifg ON ifg.y = ry AND ifg.x = rx GROUP BY mi.y, mi.x, first, second), o AS (SELECT y, x, atan2(ifg.im * t.re - ifg.re * t.im, ifg.re * t.re + ifg.im * t.im) AS phase FROM ifg JOIN t USING (y, x, first, second)) SELECT y, x, round({_COH}, 6) + 0.0 AS gamma FROM o GROUP BY y, x")
def temporal_phase_coherence(spark, sf):
    ifgs = px.interferograms(src.complex_pixels(spark, sf), _chain(spark))
    return px.temporal_coherence(ifgs, src.points(spark, sf), _HALF, _height(spark, sf), src.WIDTH).select("y", "x", _r("gamma"))


@_add(f"WITH {_PT}, {_knn('nn', 20)} SELECT a, b, d2 FROM nn WHERE d2 <> 0 AND sqrt(d2) > 1.2 AND sqrt(d2) < 2.5")
def annulus_neighbours(spark, sf):
    return px.annulus(_near(spark, sf, 20, 3.0), 1.2, 2.5).select("a", "b", "d2")


_TARGETS = "tg AS (SELECT s_suppkey AS target, (s_suppkey * 7 % 41) / 2.0 AS y, (s_suppkey * 11 % 51) / 2.0 AS x FROM supplier)"


@_add(f"WITH {_PT}, {_TARGETS}, q AS (SELECT target, point_id, ((tg.y - pt.y) ** 2 + (tg.x - pt.x) ** 2)::DOUBLE AS d2 FROM tg, pt) SELECT target, point_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d2, point_id) AS r FROM q) WHERE r = 1")
def nearest_pixel(spark, sf):
    t = src.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_id"), ((F.col("s_suppkey") * 7 % 41) / 2.0).alias("y"), ((F.col("s_suppkey") * 11 % 51) / 2.0).alias("x"))
    return px.nearest_pixel(t, src.points(spark, sf), 1.0)


_ARCS = "ar AS (SELECT DISTINCT greatest(a, b) AS src, least(a, b) AS dst, sqrt(d2) AS length FROM nn WHERE a <> b)"


@_add(f"WITH {_PT}, {_knn('nn', 6)}, {_ARCS} SELECT src, dst, round(length, 6) AS length FROM ar WHERE length <= 1.5")
def arcs_built(spark, sf):
    return graph.build_arcs(src.points(spark, sf).select("point_id", "y", "x"), 5, 1.5, 2.0).select("src", "dst", _r("length"))


@_add(f"WITH {_PT}, {_knn('nn', 6)}, {_ARCS} SELECT src, dst, round(length, 6) AS length FROM ar WHERE length <= 1.2")
def long_arcs_removed(spark, sf):
    return px.with_lengths(px.distinct_arcs(_near(spark, sf)), src.points(spark, sf)).where("length <= 1.2").select("src", "dst", _r("length"))


@_add(f"WITH {_PT}, {_knn('nn', 6)}, {_ARCS} SELECT count(*) AS n, round(min(length), 6) AS shortest, round(max(length), 6) AS longest, round(avg(length), 6) AS mean FROM ar")
def arc_lengths(spark, sf):
    arcs = px.with_lengths(px.distinct_arcs(_near(spark, sf)), src.points(spark, sf))
    return arcs.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("a"), F.max("length").alias("b"), F.avg("length").alias("c")).select("n", _r("a", "shortest"), _r("b", "longest"), _r("c", "mean"))


def bad_points_removed(spark, sf):
    """Arcs between the points that are left when the worst of those with a low median coherence go, round by round."""
    return graph.without_bad_points(_arc_gamma(spark, sf), 0.85).select("src", "dst", _r("gamma"))


QUERIES["bad_points_removed"] = bad_points_removed


_SLOPE = f"sl AS (SELECT point_id, covar_pop({_TIME}, phase) / var_pop({_TIME}) AS slope FROM pp GROUP BY point_id)"


def _model(spark, sf) -> DataFrame:
    """phases with the phase of each point's rate."""
    p = src.phases(spark, sf)
    rate = est.velocity(p.select("point_id", F.expr(_TIME).cast("double").alias("t"), F.col("phase").alias("value"))).select("point_id", "slope")
    return p.join(rate, "point_id").withColumn("model", F.col("slope") * F.expr(_TIME))


@_add(f"WITH {_PP}, {_SLOPE} SELECT point_id, k, round(atan2(sin(phase - slope * {_TIME}), cos(phase - slope * {_TIME})), 6) + 0.0 AS phase FROM pp JOIN sl USING (point_id)")
def phase_model_removed(spark, sf):
    return _model(spark, sf).select("point_id", "k", wrap(F.col("phase") - F.col("model")).alias("phase")).select("point_id", "k", _r("phase"))


@_add(f"WITH {_PP}, {_SLOPE} SELECT point_id, k, round(atan2(sin(phase - slope * {_TIME}), cos(phase - slope * {_TIME})) + slope * {_TIME}, 6) + 0.0 AS phase FROM pp JOIN sl USING (point_id)")
def phase_model_restored(spark, sf):
    return _model(spark, sf).select("point_id", "k", (wrap(F.col("phase") - F.col("model")) + F.col("model")).alias("phase")).select("point_id", "k", _r("phase"))


@_add(f"WITH {_PP} SELECT a.point_id, a.k::BIGINT AS first, b.k::BIGINT AS second, round(a.phase - b.phase, 6) + 0.0 AS phase FROM pp a JOIN pp b ON a.point_id = b.point_id AND b.k - a.k BETWEEN 1 AND 2")
def series_to_interferograms(spark, sf):
    return net.to_interferograms(src.phases(spark, sf).withColumnRenamed("k", "img"), _chain(spark, 64)).select("point_id", "first", "second", _r("phase"))


@_add(f"WITH {_PP}, {_SLOPE}, e AS (SELECT min(slope) AS lo, max(slope) AS hi, CASE WHEN count(*) < 40 THEN 10 ELSE 300 END AS bins FROM sl), b AS (SELECT point_id, slope, hi, bins, least(floor((slope - lo) / ((hi - lo) / bins)), bins - 1) AS bin FROM sl, e), t AS (SELECT bin FROM b GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1), m AS (SELECT point_id FROM b WHERE bin = (SELECT bin FROM t) AND (bin < bins - 1 OR slope < hi)), q AS (SELECT k, avg(phase) AS reference FROM pp WHERE point_id IN (SELECT point_id FROM m) GROUP BY k) SELECT point_id, k, round(phase - reference, 6) + 0.0 AS phase FROM pp JOIN q USING (k)")
def histogram_peak_reference(spark, sf):
    rates = _model(spark, sf).select("point_id", F.col("slope").alias("rate")).distinct()
    return est.to_histogram_peak(src.phases(spark, sf), rates).select("point_id", "k", _r("phase"))


@_add(f"WITH {_PX}, b AS (SELECT point_id, log10(nullif(avg(sqrt(re * re + im * im)), 0)) AS bmap FROM px GROUP BY point_id) SELECT point_id FROM b WHERE bmap IS NOT NULL AND pow(10, bmap / 10) > 0")
def valid_pixels(spark, sf):
    return px.valid(px.mean_amplitude(src.complex_pixels(spark, sf)), "bmap").select("point_id")


_G = f"g AS (SELECT point_id, {_COH} AS gamma FROM pp GROUP BY point_id), h AS (SELECT point_id, gamma, label AS siblings, point_id % 10 = 0 AS persistent FROM g JOIN pt USING (point_id))"


def _candidates(spark, sf) -> DataFrame:
    g = px.coherence(src.phases(spark, sf), "point_id").join(src.points(spark, sf), "point_id")
    return g.select("point_id", "gamma", F.col("label").alias("siblings"), (F.col("point_id") % 10 == 0).alias("persistent"))


@_add(f"WITH {_PP}, {_PT}, {_G} SELECT point_id FROM h WHERE gamma > 0.9263 AND siblings > 2")
def linked_candidates(spark, sf):
    return px.second_order(_candidates(spark, sf), "gamma", 0.9263, "siblings", 2).select("point_id")


@_add(f"WITH {_PP}, {_PT}, {_G} SELECT point_id FROM h WHERE gamma > 0.9263 OR persistent")
def linked_or_persistent_candidates(spark, sf):
    return px.second_order(_candidates(spark, sf), "gamma", 0.9263, "siblings", 2, "persistent").select("point_id")


_GEO = "geo AS (SELECT p_partkey AS point_id, p_size::DOUBLE AS height, 0.5 + p_size / 500 AS inc, 850000 + p_retailprice AS slant_range FROM part)"


@_add(f"WITH {_PT}, {_GEO} SELECT point_id, y, x, height, round(inc, 6) AS inc, round(slant_range, 6) AS slant_range FROM pt JOIN geo USING (point_id)")
def point_geometry(spark, sf):
    return src.points(spark, sf).join(src.geometry(spark, sf), "point_id").select("point_id", "y", "x", "height", _r("inc"), _r("slant_range"))


@_add(f"WITH {_ACQ} SELECT a.idx AS first, b.idx AS second, round((b.tbase - a.tbase) / 365.25, 6) + 0.0 AS tbase_ifg, b.pbase - a.pbase AS pbase_ifg FROM acq a JOIN acq b ON b.idx - a.idx BETWEEN 1 AND 3")
def network_baselines(spark, sf):
    acq = src.acquisitions(spark, sf)
    return net.with_baselines(net.of_type("stb", acq, 3), acq).select("first", "second", _r("tbase_ifg"), "pbase_ifg")


_LATLON = "ll AS (SELECT point_id, y, x, 50 + y * 0.001 + x * 0.0001 AS lat, 10 + x * 0.001 - y * 0.0001 AS lon FROM pt)"


def _places(spark, sf) -> DataFrame:
    return src.points(spark, sf).select("point_id", "y", "x", F.expr("double(50 + y * 0.001 + x * 0.0001)").alias("lat"), F.expr("double(10 + x * 0.001 - y * 0.0001)").alias("lon"))


def _corner(c: str, y: str, x: str) -> str:
    return f"(SELECT round({c}, 6) FROM ll ORDER BY y {y}, x {x} LIMIT 1)"


@_add(f"WITH {_PT}, {_LATLON} SELECT round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, " + ", ".join(f"{_corner(c, y, x)} AS {k}_{c}" for k, y, x in (("upper_left", "", ""), ("upper_right", "", "DESC"), ("lower_left", "DESC", ""), ("lower_right", "DESC", "DESC")) for c in ("lat", "lon")) + " FROM ll")
def spatial_extent(spark, sf):
    e = px.extent(_places(spark, sf))
    return e.select(*[_r(c) for c in e.columns])


_ZONE, _EAST, _NORTH = utm_sql("lat", "lon")


@_add(f"WITH {_PT}, {_LATLON} SELECT point_id, {_ZONE} AS zone, round({_EAST}, 4) + 0.0 AS easting, round({_NORTH}, 4) + 0.0 AS northing FROM ll")
def utm_coordinates(spark, sf):
    zone, east, north = utm("lat", "lon")
    return _places(spark, sf).select("point_id", zone.alias("zone"), east.alias("e"), north.alias("n")).select("point_id", "zone", _r("e", "easting", 4), _r("n", "northing", 4))


@_add(f"WITH {_PT}, z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pt), s AS (SELECT h, w, greatest(round_even((w - 1) * 3.0 / 20, 0)::INT, 1) AS across, greatest(round_even((h - 1) * 12.0 / 20, 0)::INT, 1) AS down FROM z) SELECT point_id, {_box_sql('y', 'h', 'down')} AS box_y, {_box_sql('x', 'w', 'across')} AS box_x FROM pt, s")
def metric_grid(spark, sf):
    """Cells of about 20 m on pixels of 12 m by 3 m."""
    p = src.points(spark, sf)
    h, w = p.agg(F.max("y") + 1, F.max("x") + 1).first()
    return px.boxed(p, *px.metric_edges(h, w, (h - 1) * 12.0, (w - 1) * 3.0, 20.0)).select("point_id", "box_y", "box_x")


def _first_and_rest(spark, sf):
    p = src.points(spark, sf)
    first = _first_order(spark, sf)
    one = p.join(first, "point_id", "left_semi")
    return one, px.nearest(p.join(first, "point_id", "left_anti"), one, 6, 4.0)


@_add(f"WITH {_PP}, {_PT}, {_FIRST}, {_knn('nn', 6, 'b.point_id IN (SELECT point_id FROM g1) AND a.point_id NOT IN (SELECT point_id FROM g1)')} SELECT a AS point_id, k, round(sum(phase / d2) / sum(1 / d2), 6) + 0.0 AS phase FROM nn JOIN pp ON pp.point_id = b GROUP BY a, k")
def atmosphere_by_distance(spark, sf):
    return atm.by_distance(_first_and_rest(spark, sf)[1], src.phases(spark, sf)).select("point_id", "k", _r("phase"))


def atmosphere_kriged(spark, sf):
    """Phase at points that are not of first order by local kriging from the six nearest that are."""
    one, near = _first_and_rest(spark, sf)
    return atm.krige(near, one, src.phases(spark, sf), 5.0, 1.0, 0.1).select("point_id", "k", _r("phase"))


QUERIES["atmosphere_kriged"] = atmosphere_kriged


@_add(f"WITH {_PP}, {_PT}, {_GEO}, s AS (SELECT point_id, count(*) AS n, var_pop({_BASE}) AS bb, var_pop({_TIME}) AS tt, covar_pop({_BASE}, {_TIME}) AS bt, covar_pop({_BASE}, phase) AS bv, covar_pop({_TIME}, phase) AS tv, avg({_BASE}) AS mb, avg({_TIME}) AS mt, avg(phase) AS mv FROM pp GROUP BY point_id), c AS (SELECT *, (tt * bv - bt * tv) / (bb * tt - bt * bt) AS demerr, (bb * tv - bt * bv) / (bb * tt - bt * bt) AS vel FROM s), e AS (SELECT point_id, phase - demerr * ({_BASE} - mb) - vel * ({_TIME} - mt) - mv AS phase FROM pp JOIN c USING (point_id)), o AS (SELECT point_id, {_COH} AS coherence, sum(phase * phase) AS omega FROM e GROUP BY point_id), w AS (SELECT point_id, "
      + ", ".join(f'round(max(phase) FILTER (WHERE k = {k}) * {LAMBDA} / (4 * pi()) * 1000, 6) + 0.0 AS "D{k:08d}"' for k in range(64))
      + " FROM pp GROUP BY point_id) SELECT point_id, round(vel, 6) + 0.0 AS velocity, round(coherence, 6) + 0.0 AS coherence, round(omega, 6) + 0.0 AS omega, round(demerr, 6) + 0.0 AS dem_error, height AS dem, x AS coord_x, y AS coord_y, w.* EXCLUDE (point_id) FROM c JOIN o USING (point_id) JOIN pt USING (point_id) JOIN geo USING (point_id) JOIN w USING (point_id)")
def export_rows(spark, sf):
    """The rows of an export: parameters, quality, place and one column for each epoch."""
    p = src.phases(spark, sf).select("point_id", "k", F.expr(_BASE).cast("double").alias("p"), F.expr(_TIME).cast("double").alias("t"), F.col("phase").alias("value"))
    fits = est.velocity_and_elevation(p)
    rest = p.join(fits, "point_id").withColumn("phase", F.expr("value - demerr * p - vel * t - atmosphere"))
    quality = rest.groupBy("point_id").agg(F.sqrt(F.pow(F.avg(F.cos("phase")), 2) + F.pow(F.avg(F.sin("phase")), 2)).alias("coherence"), F.sum(F.col("phase") * F.col("phase")).alias("omega"))
    place = src.points(spark, sf).join(src.geometry(spark, sf), "point_id").select("point_id", F.col("height").alias("dem"), F.col("x").alias("coord_x"), F.col("y").alias("coord_y"))
    wide = QUERIES["export_wide"](spark, sf)
    out = fits.join(quality, "point_id").join(place, "point_id").join(wide, "point_id")
    return out.select("point_id", _r("vel", "velocity"), _r("coherence"), _r("omega"), _r("demerr", "dem_error"), "dem", "coord_x", "coord_y", *[c for c in wide.columns if c != "point_id"])
