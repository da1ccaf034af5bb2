"""Further queries: three-parameter fits, searches in two dimensions, boxes, masks, export, and networks of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phase import wrap
from ..operators import elimination
from ..operators import estimation as est
from ..operators import graph
from ..operators import pixels as px
from ..operators import unwrapping as unw
from ..sources import tables as src
from .catalog import _COH, _EV, _FIT, _NEAR, _PP, _PT, LAMBDA, QUERIES, _add, _first_order, _near, _r

#: Baselines of epoch k, as text for both engines: years, and a spread of perpendicular ones that is not a line in k.
_TIME, _BASE = "(k / 64.0)", "(((k * 37) % 64 - 31.5) / 32.0)"
_BOXES, _SEGMENTS = (3, 4), [((2.0, 2.0), (10.0, 21.0)), ((10.0, 21.0), (18.0, 20.0))]
_HALF = 1.5
_GRID = [round(-2 + 0.5 * i, 1) for i in range(9)]
_EXPORTED = 64


def _rows_only(f):
    QUERIES[f.__name__] = f
    return f


def _design(spark) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("k")).select("k", F.expr(_BASE).cast("double").alias("of_demerr"), F.expr(_TIME).cast("double").alias("of_vel"))


@_add(f"WITH {_PP}, s AS (SELECT point_id, var_pop({_BASE}) AS pp, var_pop({_TIME}) AS tt, covar_pop({_BASE}, {_TIME}) AS pt, covar_pop({_BASE}, phase) AS pv, covar_pop({_TIME}, phase) AS tv, avg({_BASE}) AS p, avg({_TIME}) AS t, avg(phase) AS v FROM pp GROUP BY point_id), c AS (SELECT *, (tt * pv - pt * tv) / (pp * tt - pt * pt) AS demerr, (pp * tv - pt * pv) / (pp * tt - pt * pt) AS vel FROM s) SELECT point_id, round(demerr, 6) + 0.0 AS demerr, round(vel, 6) + 0.0 AS vel, round(v - demerr * p - vel * t, 6) + 0.0 AS atmosphere FROM c")
def velocity_lsq3(spark, sf):
    rows = src.phases(spark, sf).select("point_id", F.expr(_BASE).cast("double").alias("p"), F.expr(_TIME).cast("double").alias("t"), F.col("phase").alias("value"))
    return est.velocity_and_elevation(rows).select("point_id", _r("demerr"), _r("vel"), _r("atmosphere"))


@_add(f"WITH {_PP}, g AS (SELECT i, j, -2 + 0.5 * i AS a, -2 + 0.5 * j AS b FROM range(9) AS x(i), range(9) AS y(j)), c AS (SELECT point_id, i, j, a::DOUBLE AS a, b::DOUBLE AS b, round({_COH.replace('phase', f'(phase - {_BASE} * a - {_TIME} * b)')}, 9) AS gamma FROM pp, g GROUP BY point_id, i, j, a, b), o AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY gamma DESC, i, j) AS n FROM c) SELECT point_id, a AS demerr, b AS vel, round(gamma, 6) + 0.0 AS gamma FROM o WHERE n = 1")
def grid_search_2d(spark, sf):
    return est.grid_search_two(src.phases(spark, sf), _design(spark), _GRID, _GRID).select("point_id", "demerr", "vel", _r("gamma"))


@_add(f"WITH {_EV}, {_FIT}, g AS (SELECT slope FROM f WHERE slope IS NOT NULL), e AS (SELECT min(slope) AS lo, max(slope) AS hi FROM g) SELECT least(floor((slope - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM g, e GROUP BY 1")
def velocity_histogram(spark, sf):
    return est.histogram(est.velocity(src.series(spark, sf)).where("slope is not null"), "slope", 20)


def _box_sql(at: str, size: str, boxes: int) -> str:
    """The number of a box as box_edges() makes them; its rest of less than half a box goes to the last one."""
    step = f"greatest({size} // {boxes}, 1)"
    return f"least({at} // {step}, greatest(({size} + {step} - round_even({step} / 2, 0)::INT) // {step} - 1, 0))::INT"


@_add(f"WITH {_PT}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pt) SELECT point_id, {_box_sql('y', 'h', _BOXES[0])} AS box_y, {_box_sql('x', 'w', _BOXES[1])} AS box_x FROM pt, s")
def image_boxes(spark, sf):
    p = src.points(spark, sf)
    h, w = p.agg(F.max("y") + 1, F.max("x") + 1).first()
    return px.boxed(p, px.box_edges(h, _BOXES[0]), px.box_edges(w, _BOXES[1])).select("point_id", "box_y", "box_x")


def _line_sql() -> str:
    parts = []
    for (y1, x1), (y2, x2) in _SEGMENTS:
        dy, dx = y2 - y1, x2 - x1
        t = f"greatest(0.0, least(1.0, ((y - {y1}) * {dy} + (x - {x1}) * {dx}) / {dy * dy + dx * dx}))"
        parts.append(f"(y - {y1} - {dy} * {t}) ** 2 + (x - {x1} - {dx} * {t}) ** 2 <= {_HALF * _HALF}")
    return f"WITH {_PT} SELECT point_id, y, x FROM pt WHERE {' OR '.join(parts)}"


@_add(_line_sql())
def line_mask(spark, sf):
    line = [_SEGMENTS[0][0], *(end for _, end in _SEGMENTS)]
    vertices = spark.createDataFrame([(0, i, y, x) for i, (y, x) in enumerate(line)], "way_id long, seq int, y double, x double")
    return px.along_ways(src.points(spark, sf), vertices, _HALF).select("point_id", "y", "x")


@_add(f"WITH {_PP} SELECT point_id, " + ", ".join(f'round(max(phase) FILTER (WHERE k = {k}) * {LAMBDA} / (4 * pi()) * 1000, 6) + 0.0 AS "D{k:08d}"' for k in range(_EXPORTED)) + " FROM pp GROUP BY point_id")
def export_wide(spark, sf):
    rows = src.phases(spark, sf).select("point_id", F.format_string("D%08d", "k").alias("epoch"), (F.col("phase") * LAMBDA / (4 * F.pi()) * 1000).alias("mm"))
    wide = px.wide(rows, "mm", [f"D{k:08d}" for k in range(_EXPORTED)])
    return wide.select("point_id", *[_r(c) for c in wide.columns if c != "point_id"])


def _alike(spark, sf) -> DataFrame:
    """Arcs between near points of one label."""
    label = src.points(spark, sf).select("point_id", "label")
    arcs = px.distinct_arcs(_near(spark, sf))
    one, two = (label.select(F.col("point_id").alias(x), F.col("label").alias(f"l_{x}")) for x in ("src", "dst"))
    return arcs.join(one, "src").join(two, "dst").where("l_src = l_dst").select("src", "dst")


@_add(f"WITH RECURSIVE {_PT}, {_NEAR}, e AS (SELECT DISTINCT n.a, n.b FROM (SELECT a, b FROM nn UNION SELECT b, a FROM nn) n JOIN pt p ON p.point_id = n.a JOIN pt q ON q.point_id = n.b AND q.label = p.label), reach AS (SELECT point_id AS a, point_id AS b FROM pt UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT a AS point_id, min(b) AS component FROM reach GROUP BY a")
def network_components(spark, sf):
    return graph.components(src.points(spark, sf).select("point_id"), _alike(spark, sf))


def _arc_gamma(spark, sf) -> DataFrame:
    return px.coherence(px.arc_observations(src.phases(spark, sf), px.distinct_arcs(_near(spark, sf))), "src", "dst")


@_rows_only
def bad_arcs_removed(spark, sf):
    """Arcs of some coherence and those of the least spanning forest."""
    return graph.without_bad_arcs(_arc_gamma(spark, sf), 0.86).select("src", "dst", _r("gamma"))


@_rows_only
def temporal_unwrapping(spark, sf):
    """Elevation error, velocity and coherence of the arcs between near points."""
    arcs = px.arc_observations(src.phases(spark, sf), px.distinct_arcs(_near(spark, sf, 3, 1.0)))
    return unw.unwrap_arcs(arcs, _design(spark), 4.0, 8.0, 50).select("src", "dst", _r("demerr", digits=4), _r("vel", digits=4), _r("gamma", digits=4))


@_rows_only
def densification(spark, sf):
    """Points that are not of first order, from their nearest three points of first order."""
    p, phases = src.points(spark, sf), src.phases(spark, sf)
    first = _first_order(spark, sf)
    near = px.nearest(p.join(first, "point_id", "left_anti"), p.join(first, "point_id", "left_semi"), 3, 3.0)
    return unw.densify(phases, phases.join(first, "point_id", "left_semi"), near, _design(spark), 4.0, 8.0, 50).select("point_id", _r("demerr", digits=4), _r("vel", digits=4), _r("gamma", digits=4))


_VALUE = "list_sum(embedding::DOUBLE[])"


@_add(f"SELECT vec_id AS point_id, round({_VALUE} - (SELECT {_VALUE} FROM embeddings WHERE vec_id = 0), 3) + 0.0 AS value FROM embeddings")
def parameter_integration(spark, sf):
    """Values at points from the differences along arcs, weighted by the arcs' coherence. As the differences are those of the
    points' values, so is the result, less the reference's."""
    value = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.expr("aggregate(embedding, 0d, (t, v) -> t + v)").alias("v"))
    one, two = (value.select(F.col("point_id").alias(x), F.col("v").alias(f"v_{x}")) for x in ("src", "dst"))
    arcs = _arc_gamma(spark, sf).join(one, "src").join(two, "dst").select("src", "dst", (F.col("v_src") - F.col("v_dst")).alias("value"), F.col("gamma").alias("weight"))
    return elimination.integrate(arcs, src.points(spark, sf), 0, ["value"]).select("point_id", _r("value", digits=3))


#: A phase that is smooth in space but for the vectors' elements, as text for both engines: some cycles high, less than half of one a step.
_FIELD = "(2.5 * sin(y / 9 + k) + (k % 7) * 0.2 * (y * 0.6 + x * 0.5) + 0.2 * v)"


@_add(f"WITH {_PT}, e AS (SELECT vec_id AS point_id, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), f AS (SELECT point_id, k, {_FIELD} AS phase FROM e JOIN pt USING (point_id)) SELECT point_id, k, round(phase - avg(phase) OVER (PARTITION BY k), 6) + 0.0 AS phase FROM f")
def spatial_unwrapping(spark, sf):
    """A smooth phase, wrapped, from its wrapped differences along arcs, each epoch less its mean."""
    e = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    p = src.points(spark, sf)
    field = e.join(p, "point_id").select("point_id", "k", wrap(F.expr(_FIELD)).alias("phase"))
    return elimination.unwrap(field, px.distinct_arcs(_near(spark, sf)), p, 0).select("point_id", "k", _r("phase"))


_ISLANDS = "(x < 8 OR x > 14)"


@_add(f"WITH {_PT}, il AS (SELECT point_id, y, x FROM pt WHERE {_ISLANDS}), p AS (SELECT a.point_id AS a, b.point_id AS b, a.x < 8 AS l, b.x < 8 AS m, (a.y - b.y) ** 2 + (a.x - b.x) ** 2 AS d2 FROM il a, il b), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM p) WHERE r <= 6 AND a <> b), g AS (SELECT greatest(a, b) AS src, least(a, b) AS dst, d2 FROM p WHERE l AND NOT m ORDER BY d2, 1, 2 LIMIT 1) SELECT DISTINCT greatest(a, b) AS src, least(a, b) AS dst, round(sqrt(d2), 6) + 0.0 AS length FROM nn UNION SELECT src, dst, round(sqrt(d2), 6) + 0.0 FROM g")
def arcs_reconnected(spark, sf):
    """Arcs of two islands of points and the shortest link between them."""
    return graph.build_arcs(src.points(spark, sf).select("point_id", "y", "x").where(_ISLANDS), 5, 1.5, 2.0).select("src", "dst", _r("length"))
