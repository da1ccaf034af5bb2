"""The queries on the driver's tables, each with SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phase as ph
from ..operators import estimation as est
from ..operators import network as net
from ..operators import pixels as px
from ..sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LAMBDA, RING = 0.0556, [(2.5, 2.5), (2.5, 17.5), (14.5, 21.5), (17.5, 6.5)]
RATES, DESIGN = [round(-2 + 0.25 * i, 2) for i in range(17)], [round(k / 64, 6) for k in range(64)]
_PP = "pp AS (SELECT point_id, k, atan2(sin(pi() * v), cos(pi() * v)) AS phase FROM (SELECT vec_id AS point_id, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings))"
_PT = "pt AS (SELECT vec_id AS point_id, (vec_id // 25)::INT AS y, (vec_id % 25)::INT AS x, label FROM embeddings)"
_PX = "px AS (SELECT vec_id AS point_id, i::INT AS img, embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im FROM embeddings, range(32) AS r(i))"
_ACQ = "d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), acq AS (SELECT (row_number() OVER (ORDER BY date) - 1)::INT AS idx, date, date_diff('day', min(date) OVER (), date)::DOUBLE AS tbase, (date_diff('day', min(date) OVER (), date) * 37 % 401 - 200)::DOUBLE AS pbase FROM d)"
_EV = "ev AS (SELECT user_id AS point_id, event_id AS id, (epoch_us(ts) - 1704067200000000) / 31557600000000.0 AS t, value FROM events)"
_COH = "sqrt(avg(cos(phase)) ** 2 + avg(sin(phase)) ** 2)"
_FIT = "f AS (SELECT point_id, slope, mv - slope * mt AS offs, n * (vv - slope * tv) AS omega FROM (SELECT *, CASE WHEN tt > 0 THEN tv / tt END AS slope FROM (SELECT point_id, count(*) AS n, avg(t) AS mt, avg(value) AS mv, var_pop(t) AS tt, var_pop(value) AS vv, covar_pop(t, value) AS tv FROM ev GROUP BY point_id)))"


def _r(column: str, name: str | None = None, digits: int = 6):
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(name or column)


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _arcs(spark, sf):
    p = src.points(spark, sf)
    return p.select(F.col("point_id").alias("src"), (F.col("point_id") + 1).alias("dst"))


def _near(spark, sf, k=6, radius=2.0):
    p = src.points(spark, sf)
    return px.nearest(p, p, k, radius)


#: Points of first order are those of some coherence.
_LIMIT = 0.9265
_FIRST = f"g1 AS (SELECT point_id FROM pp GROUP BY point_id HAVING {_COH} >= {_LIMIT})"


def _first_order(spark, sf):
    return px.at_least(px.coherence(src.phases(spark, sf), "point_id"), "gamma", _LIMIT).select("point_id")


_NEAR = "nn AS (SELECT * FROM (SELECT a.point_id AS a, b.point_id AS b, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2)::DOUBLE AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.point_id) AS rank FROM pt a, pt b) WHERE rank <= 6)"


@_add(f"WITH {_PP} SELECT point_id, k, round(phase, 6) + 0.0 AS phase FROM pp")
def wrap_phase(spark, sf):
    return src.phases(spark, sf).select("point_id", "k", _r("phase"))


@_add(f"WITH {_PP} SELECT s.point_id AS src, d.point_id AS dst, s.k, round(atan2(sin(s.phase - d.phase), cos(s.phase - d.phase)), 6) + 0.0 AS phase FROM pp s JOIN pp d ON d.point_id = s.point_id + 1 AND d.k = s.k")
def arc_phase_difference(spark, sf):
    return px.arc_observations(src.phases(spark, sf), _arcs(spark, sf)).select("src", "dst", "k", _r("phase"))


@_add(f"WITH {_PP}, o AS (SELECT s.point_id AS src, d.point_id AS dst, s.phase - d.phase AS phase FROM pp s JOIN pp d ON d.point_id = s.point_id + 1 AND d.k = s.k) SELECT src, dst, round({_COH}, 6) + 0.0 AS gamma FROM o GROUP BY src, dst")
def arc_coherence(spark, sf):
    return px.coherence(px.arc_observations(src.phases(spark, sf), _arcs(spark, sf)), "src", "dst").select("src", "dst", _r("gamma"))


@_add(f"WITH {_PP} SELECT point_id, round({_COH}, 6) + 0.0 AS gamma FROM pp GROUP BY point_id")
def point_coherence(spark, sf):
    return px.coherence(src.phases(spark, sf), "point_id").select("point_id", _r("gamma"))


@_add(f"WITH {_PP} SELECT point_id, round({_COH}, 6) + 0.0 AS gamma FROM pp GROUP BY point_id HAVING {_COH} >= 0.9")
def coherence_threshold_filter(spark, sf):
    return px.at_least(px.coherence(src.phases(spark, sf), "point_id"), "gamma", 0.9).select("point_id", _r("gamma"))


def _cells(spark, sf, largest):
    g = px.coherence(src.phases(spark, sf), "point_id").join(src.points(spark, sf), "point_id")
    return px.best_in_cell(g, "gamma", 5, largest).select("cy", "cx", "point_id", _r("gamma"))


def _cells_sql(order):
    return f"WITH {_PP}, {_PT}, g AS (SELECT point_id, {_COH} AS gamma FROM pp GROUP BY point_id), c AS (SELECT y // 5 AS cy, x // 5 AS cx, point_id, gamma, row_number() OVER (PARTITION BY y // 5, x // 5 ORDER BY round(gamma, 9) {order}, y, x) AS rank FROM g JOIN pt USING (point_id)) SELECT cy::BIGINT AS cy, cx::BIGINT AS cx, point_id, round(gamma, 6) + 0.0 AS gamma FROM c WHERE rank = 1"


@_add(_cells_sql("DESC"))
def top1_per_grid_cell(spark, sf):
    return _cells(spark, sf, True)


@_add(_cells_sql("ASC"))
def least_per_grid_cell(spark, sf):
    return _cells(spark, sf, False)


@_add(f"WITH {_PT}, s AS (SELECT max(y) + 1 AS h FROM pt), v AS (SELECT y, x, list_sum(embedding::DOUBLE[]) AS v FROM pt JOIN embeddings ON vec_id = point_id), m AS (SELECT a.y, a.x, dy, dx, CASE WHEN a.y + dy < 0 THEN -1 - a.y - dy WHEN a.y + dy >= h THEN 2 * h - 1 - a.y - dy ELSE a.y + dy END AS ry, CASE WHEN a.x + dx < 0 THEN -1 - a.x - dx WHEN a.x + dx >= 25 THEN 49 - a.x - dx ELSE a.x + dx END AS rx FROM v a, s, range(-2, 3) AS i(dy), range(-2, 3) AS j(dx) WHERE dy <> 0 OR dx <> 0) SELECT m.y, m.x, round(sum(v.v), 6) + 0.0 AS total FROM m JOIN v ON v.y = ry AND v.x = rx GROUP BY m.y, m.x")
def moving_box_sum_excl_center(spark, sf):
    rows = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.expr("aggregate(embedding, 0d, (t, v) -> t + v)").alias("v")).join(src.points(spark, sf), "point_id")
    height = _height(spark, sf)
    return px.box_sum(rows, "v", 2, height, src.WIDTH).select("y", "x", _r("total"))


def _height(spark, sf) -> int:
    return src.points(spark, sf).agg(F.max("y")).first()[0] + 1


@_add(f"WITH {_PX} SELECT point_id, round(log10(nullif(avg(sqrt(re * re + im * im)), 0)), 6) + 0.0 AS bmap FROM px GROUP BY point_id")
def mean_amplitude_log10(spark, sf):
    return px.mean_amplitude(src.complex_pixels(spark, sf)).select("point_id", _r("bmap"))


def _chain(spark, images=32, links=2):
    return spark.createDataFrame([(i, j) for i in range(images) for j in range(i + 1, min(i + links, images - 1) + 1)], "first long, second long")


@_add(f"WITH {_PX} SELECT a.point_id, a.img::BIGINT AS first, b.img::BIGINT AS second, round(a.re * b.re + a.im * b.im, 6) + 0.0 AS re, round(a.im * b.re - a.re * b.im, 6) + 0.0 AS im FROM px a JOIN px b ON a.point_id = b.point_id AND b.img - a.img BETWEEN 1 AND 2")
def interferogram_formation(spark, sf):
    return px.interferograms(src.complex_pixels(spark, sf), _chain(spark)).select("point_id", "first", "second", _r("re"), _r("im"))


def _net_sql(pairs):
    return f"WITH {_ACQ}, far AS (SELECT a.idx AS i, b.idx AS j, b.tbase - a.tbase AS dt FROM acq a, acq b), p AS ({pairs}) SELECT DISTINCT i AS first, j AS second, round((b.tbase - a.tbase) / 365.25, 6) + 0.0 AS tbase_ifg FROM p JOIN acq a ON a.idx = i JOIN acq b ON b.idx = j WHERE i <> j"


def _net(frame):
    return frame.select("first", "second", _r("tbase_ifg"))


@_add(_net_sql("SELECT (SELECT (count(*) // 2)::INT FROM acq) AS i, idx AS j FROM acq"))
def network_star(spark, sf):
    return _net(net.star(src.acquisitions(spark, sf)))


@_add(_net_sql("SELECT i, j FROM far WHERE j - i BETWEEN 1 AND 3"))
def network_stb(spark, sf):
    return _net(net.small_temporal(src.acquisitions(spark, sf), 3))


@_add(_net_sql("SELECT i, j FROM far WHERE j - i BETWEEN 1 AND 3 UNION SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(dt - 365.25), j) AS r FROM far) WHERE r = 1 AND j <> (SELECT max(idx) FROM acq)"))
def network_stb_year(spark, sf):
    return _net(net.small_temporal_yearly(src.acquisitions(spark, sf), 3))


@_add(_net_sql("SELECT i, i + 1 AS j FROM (SELECT DISTINCT i FROM far) WHERE i < (SELECT max(idx) FROM acq) UNION SELECT i, floor(i + n * (j - i) / 3.0)::INT AS j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(dt - 100), j) AS r FROM far), range(1, 4) AS s(n) WHERE r = 1 AND j > i AND i < (SELECT max(idx) FROM acq) - 1"))
def network_sb(spark, sf):
    return _net(net.small_baseline(src.acquisitions(spark, sf), 4, 100))


@_add(f"WITH {_ACQ}, p AS (SELECT a.idx AS i, b.idx AS j, row_number() OVER (ORDER BY a.idx, b.idx) - 1 AS ifg FROM acq a JOIN acq b ON b.idx - a.idx BETWEEN 1 AND 3) SELECT ifg::INT AS ifg, i AS img, 1 AS sign FROM p UNION ALL SELECT ifg::INT, j, -1 FROM p")
def network_design_matrix(spark, sf):
    return net.design_matrix(net.small_temporal(src.acquisitions(spark, sf), 3))


@_add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def date_range_mask(spark, sf):
    return src.table(spark, sf, "orders").where(F.col("o_orderdate").cast("date").between("1995-01-01", "1996-06-30")).select("o_orderkey", "o_custkey")


@_add(f"WITH {_EV}, {_FIT} SELECT point_id, round(slope, 6) + 0.0 AS slope, round(offs, 6) + 0.0 AS offs FROM f")
def velocity_lsq2(spark, sf):
    return est.velocity(src.series(spark, sf)).select("point_id", _r("slope"), _r("offset", "offs"))


@_add(f"WITH {_EV}, {_FIT} SELECT ev.point_id, id, round(value - slope * t - offs, 6) + 0.0 AS residual FROM ev JOIN f USING (point_id)")
def lsq_residuals(spark, sf):
    s = src.series(spark, sf)
    return est.residuals(s, est.velocity(s)).select("point_id", "id", _r("residual"))


@_add(f"WITH {_EV}, {_FIT}, r AS (SELECT ev.point_id, value - slope * t - offs AS phase FROM ev JOIN f USING (point_id) WHERE slope IS NOT NULL) SELECT point_id, round({_COH}, 6) + 0.0 AS gamma FROM r GROUP BY point_id")
def lsq_coherence(spark, sf):
    s = src.series(spark, sf)
    return px.coherence(est.residuals(s, est.velocity(s)).where("slope is not null").withColumn("phase", F.col("residual")), "point_id").select("point_id", _r("gamma"))


@_add(f"WITH {_EV}, l AS (SELECT point_id, value AS v, lead(value) OVER (PARTITION BY point_id ORDER BY t, id) AS w FROM ev) SELECT point_id, round(CASE WHEN stddev_pop(v) > 0 AND stddev_pop(w) > 0 THEN abs(covar_pop(v, w) / (stddev_pop(v) * stddev_pop(w))) END, 6) + 0.0 AS autocorrelation FROM l WHERE w IS NOT NULL GROUP BY point_id")
def temporal_autocorrelation(spark, sf):
    return est.autocorrelation(src.series(spark, sf), "value", ["t", "id"]).select("point_id", _r("autocorrelation"))


@_add(f"WITH {_PT}, {_NEAR} SELECT a, b, d2, rank::INT AS rank FROM nn")
def knn_pixel(spark, sf):
    return _near(spark, sf).select("a", "b", "d2", "rank")


@_add(f"WITH {_PT} SELECT a.point_id AS a, b.point_id AS b, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2)::DOUBLE AS d2 FROM pt a JOIN pt b ON a.point_id <> b.point_id AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9")
def radius_neighbours(spark, sf):
    p = src.points(spark, sf)
    return px.within(p, p, 3.0).where("a <> b")


@_add(f"WITH {_PP}, {_PT}, {_FIRST}, q AS (SELECT a.point_id AS a, b.point_id AS b, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2)::DOUBLE AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.point_id) AS rank FROM pt a, pt b WHERE b.point_id IN (SELECT point_id FROM g1)) SELECT a, b, d2, rank::INT AS rank FROM q WHERE rank <= 5 AND (rank <= 3 OR (d2 < 4 AND d2 <> 0))")
def knn_densify_neighbours(spark, sf):
    p = src.points(spark, sf)
    return px.nearest(p, p.join(_first_order(spark, sf), "point_id", "left_semi"), 5, 3.0).where("rank <= 3 or (d2 < 4 and d2 <> 0)").select("a", "b", "d2", "rank")


@_add(f"WITH {_PT}, {_NEAR} SELECT DISTINCT greatest(a, b) AS src, least(a, b) AS dst FROM nn WHERE a <> b")
def arc_dedup(spark, sf):
    return px.distinct_arcs(_near(spark, sf))


@_add(f"WITH {_PP}, {_PT}, {_NEAR}, e AS (SELECT DISTINCT greatest(a, b) AS src, least(a, b) AS dst FROM nn WHERE a <> b), o AS (SELECT src, dst, {_COH.replace('phase', '(s.phase - d.phase)')} AS gamma FROM e JOIN pp s ON s.point_id = src JOIN pp d ON d.point_id = dst AND d.k = s.k GROUP BY src, dst), u AS (SELECT src AS point_id, gamma FROM o UNION ALL SELECT dst, gamma FROM o) SELECT point_id, round(median(gamma), 6) + 0.0 AS gamma FROM u GROUP BY point_id")
def arc_median_by_node(spark, sf):
    arcs = px.distinct_arcs(_near(spark, sf))
    return est.node_median(px.coherence(px.arc_observations(src.phases(spark, sf), arcs), "src", "dst")).select("point_id", _r("gamma"))


@_add(f"WITH {_PP}, {_PT}, {_NEAR}, s AS (SELECT point_id, k, phase - lag(phase) OVER (PARTITION BY point_id ORDER BY k) AS step FROM pp), m AS (SELECT a, b, sqrt(sum((p.step - q.step) ** 2) / count(*)) AS rms FROM nn JOIN s p ON p.point_id = a JOIN s q ON q.point_id = b AND q.k = p.k WHERE a <> b AND p.step IS NOT NULL GROUP BY a, b) SELECT a AS point_id, round(min(rms) * {LAMBDA} / (4 * pi()), 6) + 0.0 AS consistency FROM m GROUP BY a")
def spatiotemporal_consistency(spark, sf):
    return px.consistency(src.phases(spark, sf), _near(spark, sf).where("a <> b"), LAMBDA).select("point_id", _r("consistency"))


@_add(f"WITH {_PP}, {_PT}, {_NEAR}, s AS (SELECT point_id, k, phase - lag(phase) OVER (PARTITION BY point_id ORDER BY k) AS step FROM pp), m AS (SELECT a, b, sqrt(sum((p.step - q.step) ** 2) / count(*)) AS rms FROM nn JOIN s p ON p.point_id = a JOIN s q ON q.point_id = b AND q.k = p.k WHERE d2 <> 0 AND sqrt(d2) > 1.2 AND p.step IS NOT NULL GROUP BY a, b) SELECT a AS point_id, round(min(rms) * {LAMBDA} / (4 * pi()), 6) + 0.0 AS consistency FROM m GROUP BY a")
def consistency_in_ring(spark, sf):
    p = src.points(spark, sf)
    return px.spatiotemporal_consistency(src.phases(spark, sf), p, LAMBDA, 6, 1.2, radius=2.0).select("point_id", _r("consistency"))


@_add(f"WITH {_EV}, {_FIT}, g AS (SELECT * FROM f WHERE slope IS NOT NULL), e AS (SELECT min(slope) AS lo, max(slope) AS hi FROM g), b AS (SELECT g.*, hi, least(floor((slope - lo) / ((hi - lo) / 10)), 9) AS bin FROM g, e), t AS (SELECT bin FROM b GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1) SELECT point_id, round(slope, 6) + 0.0 AS slope FROM b WHERE bin = (SELECT bin FROM t) AND (bin < 9 OR slope < hi)")
def velocity_histogram_mode(spark, sf):
    return est.peak_members(est.velocity(src.series(spark, sf)).where("slope is not null"), "slope", 10).select("point_id", _r("slope"))


@_add(f"WITH {_PP} SELECT point_id, k, round(phase - avg(phase) OVER (PARTITION BY k), 6) + 0.0 AS phase FROM pp")
def mean_removed_per_epoch(spark, sf):
    return est.without_epoch_mean(src.phases(spark, sf)).select("point_id", "k", _r("phase"))


@_add(f"WITH {_PP} SELECT p.point_id, p.k, round(p.phase - r.phase, 6) + 0.0 AS phase FROM pp p JOIN pp r ON r.point_id = 0 AND r.k = p.k")
def reference_point_removed(spark, sf):
    return est.without_reference(src.phases(spark, sf), 0).select("point_id", "k", _r("phase"))


@_add(f"WITH {_PP}, g AS (SELECT i::INT AS i, -2 + 0.25 * i AS rate FROM range(17) AS r(i)), c AS (SELECT point_id, i, rate::DOUBLE AS rate, round({_COH.replace('phase', '(phase - round(k / 64, 6) * rate)')}, 9) AS gamma FROM pp, g GROUP BY point_id, i, rate), o AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY gamma DESC, i) AS r FROM c) SELECT point_id, rate, round(gamma, 6) + 0.0 AS gamma FROM o WHERE r = 1")
def grid_search_coherence(spark, sf):
    return est.grid_search(src.phases(spark, sf), DESIGN, RATES).select("point_id", "rate", _r("gamma"))


_IMAGES = 33
#: As many pairs as there are epochs.
_PAIRS = [(i, j) for i in range(_IMAGES) for j in range(i + 1, min(i + 2, _IMAGES - 1) + 1)] + [(0, _IMAGES - 1)]
_WEIGHTS = est.inversion_weights(_PAIRS, _IMAGES)
_W_SQL = ", ".join(f"({j}, {i}, {float(_WEIGHTS[i, j])!r}::DOUBLE)" for i in range(_IMAGES) for j in range(len(_PAIRS)))


@_add(f"WITH {_PP}, w AS (SELECT * FROM (VALUES {_W_SQL}) AS t(ifg, img, w)) SELECT point_id, img, round(sum(w * phase), 6) + 0.0 AS phase FROM pp JOIN w ON ifg = k GROUP BY point_id, img")
def ifg_inversion(spark, sf):
    ifg = src.phases(spark, sf).withColumnRenamed("k", "ifg")
    return est.invert(ifg, _PAIRS, _IMAGES).select("point_id", "img", _r("phase"))


@_add(f"WITH {_PT} SELECT point_id, y, x FROM pt WHERE point_id NOT IN (SELECT point_id FROM pt WHERE label = 3)")
def unstable_points_anti(spark, sf):
    p = src.points(spark, sf)
    return p.join(p.where("label = 3").select("point_id"), "point_id", "left_anti").select("point_id", "y", "x")


@_add(f"WITH {_PT} SELECT point_id, y, x FROM pt WHERE label IN (1, 2)")
def keep_ids_semi(spark, sf):
    p = src.points(spark, sf)
    return p.join(p.where("label in (1, 2)").select("point_id"), "point_id", "left_semi").select("point_id", "y", "x")


@_add(f"WITH {_PT} SELECT point_id, y, x FROM pt WHERE label = 1 UNION ALL SELECT point_id, y, x FROM pt WHERE label = 2 AND point_id NOT IN (SELECT point_id FROM pt WHERE label = 1)")
def points_union(spark, sf):
    p = src.points(spark, sf).select("point_id", "y", "x", "label")
    one, two = p.where("label = 1").drop("label"), p.where("label = 2").drop("label")
    return one.unionByName(two.join(one, "point_id", "left_anti"))


@_add(f"WITH {_PT}, v AS (SELECT pt.*, list_sum(embedding::DOUBLE[]) AS v FROM pt JOIN embeddings ON vec_id = point_id) SELECT floor(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2))::INT AS bin, count(*) AS n, round(0.5 * avg((a.v - b.v) ** 2), 6) + 0.0 AS semivariance FROM v a JOIN v b ON a.point_id < b.point_id AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 25 GROUP BY 1")
def empirical_variogram(spark, sf):
    p = src.points(spark, sf)
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.expr("aggregate(embedding, 0d, (t, v) -> t + v)").alias("value"))
    return est.variogram(v, px.within(p, p, 5.0), 1.0).select("bin", "n", _r("semivariance"))


@_add(f"WITH {_EV} SELECT point_id, id, round(1000 * (value * {LAMBDA} / (4 * pi()) - t * 30 / (850000 * sin(0.6)) * 5), 6) + 0.0 AS mm FROM ev")
def displacement_mm(spark, sf):
    mm = ph.displacement_mm(F.col("value"), F.lit(5.0), F.col("t") * 30, F.lit(850000.0), F.lit(0.6), LAMBDA)
    return src.series(spark, sf).select("point_id", "id", mm.alias("mm")).select("point_id", "id", _r("mm"))


@_add(f"WITH {_PP} SELECT point_id, k, round(100 * phase * {LAMBDA} / (4 * pi()), 6) + 0.0 AS cm FROM pp WHERE k BETWEEN 8 AND 23")
def image_range_cm(spark, sf):
    """Line-of-sight lengths of a range of images, for every point."""
    some = ph.images_between(src.phases(spark, sf), 8, 24)
    return some.select("point_id", "k", ph.in_unit(F.col("phase") * LAMBDA / (4 * math.pi), "cm").alias("cm")).select("point_id", "k", _r("cm"))


@_add(f"WITH {_EV} SELECT point_id, id, round(4 * pi() / {LAMBDA} * t * 0.01 + 4 * pi() / {LAMBDA} * (value / 10) / (850000 * sin(0.6)) * 12, 6) + 0.0 AS phase FROM ev")
def phase_model(spark, sf):
    m = ph.model_phase(F.lit(0.01), F.lit(12.0), F.col("t"), F.col("value") / 10, F.lit(850000.0), F.lit(0.6), LAMBDA)
    return src.series(spark, sf).select("point_id", "id", m.alias("phase")).select("point_id", "id", _r("phase"))


@_add("SELECT p_partkey, round(p_size / tan(0.6) * cos(radians(-168)), 6) + 0.0 AS east, round(-(p_size / tan(0.6)) * sin(radians(-168)), 6) + 0.0 AS north FROM part")
def geolocation_shift(spark, sf):
    e, n = ph.geolocation_shift(F.col("p_size"), F.lit(math.radians(-168)), F.lit(0.6))
    return src.table(spark, sf, "part").select("p_partkey", e.alias("east"), n.alias("north")).select("p_partkey", _r("east"), _r("north"))


def _ring_sql():
    parts = [f"(({y1} > y) <> ({y2} > y) AND x < {x1} + {(x2 - x1) / (y2 - y1)!r} * (y - {y1}))::INT" for (y1, x1), (y2, x2) in zip(RING, RING[1:] + RING[:1]) if y1 != y2]
    return f"WITH {_PT} SELECT point_id, y, x FROM pt WHERE ({' + '.join(parts)}) % 2 = 1"


@_add(_ring_sql())
def polygon_mask(spark, sf):
    vertices = spark.createDataFrame([(0, i, y, x) for i, (y, x) in enumerate(RING)], "way_id long, seq int, y double, x double")
    return px.in_polygons(src.points(spark, sf), vertices).select("point_id", "y", "x")


@_add("SELECT l_partkey // 50 AS cell, max(l_extendedprice) AS best, count(*) AS n FROM lineitem GROUP BY 1")
def extent_per_cell(spark, sf):
    return src.table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_partkey") / 50).alias("cell")).agg(F.max("l_extendedprice").alias("best"), F.count(F.lit(1)).alias("n"))


FLAGSHIP = "top1_per_grid_cell"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most coherent point of each grid cell with the velocity of its epochs: selection, join and least squares in one
    lazy plan without Python."""
    best = QUERIES[FLAGSHIP](spark, sf_dir)
    s = src.phases(spark, sf_dir).select("point_id", (F.col("k") / 64).alias("t"), F.col("phase").alias("value"))
    return best.join(est.velocity(s).select("point_id", _r("slope", "velocity")), "point_id")
