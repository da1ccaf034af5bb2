"""Queries on ways: chosen by tags within a box, put to pixels, and as masks. Nodes are places of customers in and around the image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ways
from ..sources import tables as src
from .catalog import _PT, _add
from .points import _LATLON, _places

#: Places in pixels, never halfway between two, and in degrees; as text for both engines.
_Y, _X = "((c_custkey * 37 % 97) / 3 - 6)", "((c_custkey * 11 % 101) / 3 - 4)"
_LAT, _LON = f"(50 + {_Y} * 0.001 + {_X} * 0.0001)", f"(10 + {_X} * 0.001 - {_Y} * 0.0001)"
_NODES = f"no AS (SELECT c_custkey AS node_id, c_nationkey AS way_id, {_LAT}::DOUBLE AS lat, {_LON}::DOUBLE AS lon FROM customer)"
_BOX = (50.002, 10.002, 50.012, 10.009)
_HALF = 0.53


def _nodes(spark, sf) -> DataFrame:
    return src.table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("way_id"), F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))


_ROADS = ["motorway", "trunk_link", "residential", "track"]
_OF_SIZE = [("highway", f"CASE p_size % 5 {' '.join(f'WHEN {i} THEN ' + repr(r) for i, r in enumerate(_ROADS))} END"), ("railway", "CASE WHEN p_size % 5 = 4 THEN CASE WHEN p_size % 2 = 0 THEN 'rail' ELSE 'tram' END END"),
            ("bridge", "CASE WHEN p_size % 3 = 0 THEN 'yes' END"), ("area", "CASE WHEN p_size % 7 = 0 THEN 'no' END")]
#: Each way has three nodes.
_REFS = [f"(1 + p_partkey * {i} % (SELECT count(*) FROM customer))" for i in (3, 7, 10)]


def _tagged(spark, sf) -> DataFrame:
    n = src.table(spark, sf, "customer").count()
    part = src.table(spark, sf, "part")
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in _OF_SIZE]), F.array(*[F.expr(v) for _, v in _OF_SIZE])), lambda k, v: v.isNotNull())
    return part.select(F.col("p_partkey").alias("way_id"), tags.alias("tags"), F.array(*[F.expr(f"1 + p_partkey * {i} % {n}") for i in (3, 7, 10)]).alias("refs"))


def _clip_sql(where: str) -> str:
    s, w, n, e = _BOX
    sides = [("-dx", f"lon - {w}"), ("dx", f"{e} - lon"), ("-dy", f"lat - {s}"), ("dy", f"{n} - lat")]
    fine = " AND ".join(f"({p} <> 0 OR {q} >= 0)" for p, q in sides)
    lo = "greatest(0.0, " + ", ".join(f"CASE WHEN {p} < 0 THEN ({q}) / ({p}) ELSE 0 END" for p, q in sides) + ")"
    hi = "least(1.0, " + ", ".join(f"CASE WHEN {p} > 0 THEN ({q}) / ({p}) ELSE 1 END" for p, q in sides) + ")"
    tags = ", ".join(f"{v} AS {k}" for k, v in _OF_SIZE)
    refs = " UNION ALL ".join(f"SELECT p_partkey AS way_id, {i} AS seq, {r} AS node_id FROM part" for i, r in enumerate(_REFS))
    return f"""WITH {_NODES}, wa AS (SELECT p_partkey AS way_id, {tags} FROM part), rf AS ({refs}), v AS (SELECT rf.way_id, seq, lat, lon FROM rf JOIN no USING (node_id)),
ed AS (SELECT way_id, lat, lon, coalesce(lead(lat) OVER o, lat) - lat AS dy, coalesce(lead(lon) OVER o, lon) - lon AS dx FROM v WINDOW o AS (PARTITION BY way_id ORDER BY seq)),
hit AS (SELECT DISTINCT way_id FROM ed WHERE {fine} AND {lo} <= {hi})
SELECT way_id, highway, railway, bridge FROM wa WHERE area IS NULL AND way_id IN (SELECT way_id FROM hit) AND ({where})"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("way_id", *[F.try_element_at("tags", F.lit(k)).alias(k) for k in ("highway", "railway", "bridge")])


@_add(_clip_sql("highway IN ('residential', 'track') OR railway = 'rail'"))
def tagged_ways(spark, sf):
    return _shown(ways.infrastructure(_tagged(spark, sf), _nodes(spark, sf), _BOX, ["residential", "track", "rail"]))


@_add(_clip_sql("bridge IS NOT NULL AND (regexp_matches(highway, '^(motorway|motorway_link|trunk|trunk_link)$') OR railway = 'rail')"))
def tagged_bridges(spark, sf):
    return _shown(ways.bridges(_tagged(spark, sf), _nodes(spark, sf), _BOX, True, True))


def _parts_sql() -> str:
    """The parts of ways in the image, by all pairs of vertices and pixels."""
    near = lambda name, source, keys: f"{name} AS (SELECT * FROM (SELECT s.*, ll.y, ll.x, ll.lat AS lat_p, ll.lon AS lon_p, sqrt((s.lat - ll.lat) ** 2 + (s.lon - ll.lon) ** 2) AS off, row_number() OVER (PARTITION BY {keys} ORDER BY (s.lat - ll.lat) ** 2 + (s.lon - ll.lon) ** 2, ll.y, ll.x) AS r FROM {source} s, ll) WHERE r = 1)"
    far = lambda p, q: f"sqrt((lat{p} - lat{q}) ** 2 + (lon{p} - lon{q}) ** 2)"
    cosine = f"(({far('', '_p')} ** 2 + {far('', '_in')} ** 2 - {far('_in', '_p')} ** 2) / (2 * {far('', '_p')} * {far('', '_in')}))"
    share = f"least(CASE WHEN {cosine} > 0 THEN {far('', '_p')} / {cosine} / {far('', '_in')} ELSE 1 END, 1)"
    return f"""{_PT}, {_LATLON}, {_NODES}, v AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY node_id) AS seq, lat, lon FROM no),
sp AS (SELECT avg(d) AS spacing FROM (SELECT sqrt((ll.lat - f.lat) ** 2 + (ll.lon - f.lon) ** 2) AS d FROM ll, (SELECT lat, lon FROM ll ORDER BY y, x LIMIT 1) f ORDER BY d LIMIT 10) WHERE d > 0),
{near('n1', 'v', 's.way_id, s.seq')}, n2 AS (SELECT n1.*, off > {ways.NEAR} * spacing AS outside FROM n1, sp),
n3 AS (SELECT *, lag(outside) OVER o AS before, lead(outside) OVER o AS after, lag(lat) OVER o AS lat_b, lag(lon) OVER o AS lon_b, lead(lat) OVER o AS lat_a, lead(lon) OVER o AS lon_a FROM n2 WINDOW o AS (PARTITION BY way_id ORDER BY seq)),
eg AS (SELECT way_id, seq, 1 AS turn, lat, lon, lat_b AS lat_in, lon_b AS lon_in, lat_p, lon_p FROM n3 WHERE outside AND before = FALSE UNION ALL SELECT way_id, seq, 2, lat, lon, lat_a, lon_a, lat_p, lon_p FROM n3 WHERE outside AND after = FALSE AND coalesce(before, TRUE)),
ct AS (SELECT way_id, seq, turn, lat + (lat_in - lat) * {share} AS lat, lon + (lon_in - lon) * {share} AS lon FROM eg), {near('n4', 'ct', 's.way_id, s.seq, s.turn')},
al AS (SELECT way_id, seq, 0 AS turn, y, x FROM n3 WHERE NOT outside UNION ALL SELECT way_id, seq, turn, y, x FROM n4),
bg AS (SELECT *, turn = 2 OR lag(turn) OVER o IS NULL OR lag(turn) OVER o = 1 AS begins FROM al WINDOW o AS (PARTITION BY way_id ORDER BY seq, turn)),
pa AS (SELECT *, (sum(begins::INT) OVER (PARTITION BY way_id ORDER BY seq, turn) - 1)::BIGINT AS part FROM bg),
parts AS (SELECT way_id, part, (row_number() OVER (PARTITION BY way_id, part ORDER BY seq, turn) - 1)::INT AS seq, y, x FROM pa)"""


def _ways(spark, sf) -> DataFrame:
    """The nodes of a nation's customers, one after the other, as a way that leaves the image and returns."""
    return _nodes(spark, sf).select("way_id", F.col("node_id").alias("seq"), "lat", "lon")


@_add(f"WITH {_parts_sql()} SELECT way_id, part, seq, y, x FROM parts")
def ways_in_image(spark, sf):
    return ways.in_image(_ways(spark, sf), _places(spark, sf).select("y", "x", "lat", "lon"), False)


@_add(f"WITH {_parts_sql()}, e AS (SELECT y AS y1, x AS x1, coalesce(lead(y) OVER o, y) AS y2, coalesce(lead(x) OVER o, x) AS x2 FROM parts WINDOW o AS (PARTITION BY way_id, part ORDER BY seq)), g AS (SELECT *, y2 - y1 AS dy, x2 - x1 AS dx FROM e), d AS (SELECT pt.y, pt.x, pt.y - y1 AS py, pt.x - x1 AS px, dy, dx, greatest(0.0, least(1.0, coalesce(((pt.y - y1) * dy + (pt.x - x1) * dx) / nullif(dy * dy + dx * dx, 0), 0))) AS t FROM pt, g) SELECT DISTINCT y, x FROM d WHERE (py - t * dy) ** 2 + (px - t * dx) ** 2 <= {_HALF * _HALF!r}")
def way_mask(spark, sf):
    return ways.mask(_ways(spark, sf), _places(spark, sf).select("y", "x", "lat", "lon"), False, 2 * _HALF)
