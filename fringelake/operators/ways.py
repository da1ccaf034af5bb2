"""Ways with tags, and their masks in the image: ways chosen by tags within a box, vertices put to pixels, cut at the image's edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch
from .pixels import along_ways, in_polygons, nearest

#: Classes of roads whose bridges count.
BRIDGES = "^(motorway|motorway_link|trunk|trunk_link)$"
#: A vertex is in the image if a pixel is nearer than this many mean distances of near pixels.
NEAR = 1.3


def vertices(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, seq, lat, lon) of ways (way_id, refs: an array of node ids in order) over nodes (node_id, lat, lon). A node that
    is not in the table is passed over; seq keeps its place."""
    of = ways.select("way_id", F.posexplode("refs").alias("seq", "node_id"))
    return of.join(nodes.select("node_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), "node_id").select("way_id", "seq", "lat", "lon")


def lines(places: DataFrame, of: str) -> DataFrame:
    """The vertices (way_id, seq, lat, lon) as one line of text each in Well-Known Text, in the column `of`."""
    at = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("p"))))
    return places.groupBy("way_id").agg(F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(at, lambda x: x["p"]), ", "), F.lit(")")).alias(of))


def touching(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The ids of ways that have a node in a box or an edge through it (least lat, least lon, greatest lat, greatest lon); the
    box's edges belong to it. An edge is clipped by the four sides in turn: it meets the box if something is left."""
    south, west, north, east = (F.lit(float(v)) for v in box)
    w = Window.partitionBy("way_id").orderBy("seq")
    e = vertices(ways, nodes).withColumn("lat2", F.coalesce(F.lead("lat").over(w), F.col("lat"))).withColumn("lon2", F.coalesce(F.lead("lon").over(w), F.col("lon")))
    dy, dx = F.col("lat2") - F.col("lat"), F.col("lon2") - F.col("lon")
    lo, hi, fine = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, F.col("lon") - west), (dx, east - F.col("lon")), (-dy, F.col("lat") - south), (dy, north - F.col("lat"))):
        fine = fine & ((p != 0) | (q >= 0))
        lo = F.greatest(lo, F.when(p < 0, q / p).otherwise(0.0))
        hi = F.least(hi, F.when(p > 0, q / p).otherwise(1.0))
    return e.where(fine & (lo <= hi)).select("way_id").distinct()


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def infrastructure(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], kinds: list[str]) -> DataFrame:
    """Ways (way_id, tags: a map, refs) of the kinds within the box: rail is a kind of railway, all others are of highways. Ways with an
    `area` tag, whatever it says, are left out. No way at all raises ValueError."""
    roads = [k for k in kinds if k != "rail"]
    wanted = _tag("highway").isin(roads) if roads else F.lit(False)
    if "rail" in kinds:
        wanted = F.coalesce(wanted, F.lit(False)) | F.coalesce(_tag("railway") == "rail", F.lit(False))
    return _found(ways.where(wanted), nodes, box, "no roads or railway tracks")


def bridges(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], highway: bool = False, railway: bool = False) -> DataFrame:
    """Ways with a `bridge` tag within the box: of large roads, of rails, of both, or all of them if neither is asked for. Otherwise as
    infrastructure()."""
    of_road, of_rail = F.coalesce(_tag("highway").rlike(BRIDGES), F.lit(False)), F.coalesce(_tag("railway") == "rail", F.lit(False))
    wanted = F.lit(True) if not (highway or railway) else (of_road if highway else F.lit(False)) | (of_rail if railway else F.lit(False))
    return _found(ways.where(_tag("bridge").isNotNull() & wanted), nodes, box, "no bridges")


def _found(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], missing: str) -> DataFrame:
    # tags first: they leave few ways, whose nodes are then joined
    some = ways.where(_tag("area").isNull())
    out = some.join(touching(some, nodes, box), "way_id", "left_semi")
    if out.isEmpty():
        raise ValueError(f"{missing} within the box")
    return out


def pixel_spacing(lookup: DataFrame) -> float:
    """The mean distance from the first pixel (least y, then x) of a lookup table (y, x, lat, lon) to its nine nearest ones, in degrees."""
    known = lookup.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    first = known.orderBy("y", "x").first()
    if first is None:
        raise ValueError("the lookup table has no places")
    d = F.hypot(F.col("lat") - first.lat, F.col("lon") - first.lon).alias("d")
    return known.select(d).orderBy("d").limit(10).where("d > 0").agg(F.avg("d")).first()[0] or 0.0


def _nearest(places: DataFrame, lookup: DataFrame, spacing: float) -> DataFrame:
    """(id, y, x, lat_p, lon_p, off) of places (id, lat, lon): the nearest pixel, its place, and how far it is."""
    pixels = lookup.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    pixels = pixels.select((F.col("y").cast("long") * (1 << 31) + F.col("x")).alias("point_id"), F.col("lat").alias("lat_p"), F.col("lon").alias("lon_p"))
    near = nearest(places.select(F.col("id").alias("point_id"), F.col("lat").alias("y"), F.col("lon").alias("x")), pixels.select("point_id", F.col("lat_p").alias("y"), F.col("lon_p").alias("x")), 1, 2 * spacing)
    at = near.select(F.col("a").alias("id"), F.col("b").alias("point_id"), F.sqrt("d2").alias("off")).join(pixels, "point_id")
    return at.select("id", F.shiftright("point_id", 31).cast("int").alias("y"), F.col("point_id").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("x"), "lat_p", "lon_p", "off")


def in_image(places: DataFrame, lookup: DataFrame, closed: bool) -> DataFrame:
    """(way_id, part, seq, y, x): the ways (way_id, seq, lat, lon) as lines of pixels by a lookup table (y, x, lat, lon), cut where they
    leave the image. A vertex further than NEAR spacings from the nearest pixel is outside; a vertex outside beside one inside
    becomes the pixel nearest to the place on the edge between them that lies, seen from the outer one, beside its own nearest pixel.

    A line is cut into parts, each a run of vertices inside with the vertex outside before it and after it. A closed way stays
    one part, with the places where it leaves and returns in place of what is outside. Ways without a vertex inside are left out."""
    spacing = pixel_spacing(lookup)
    limit = NEAR * spacing
    known = places.select("way_id", "seq", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    if closed:
        # a ring ends where it began
        ring = known.groupBy("way_id").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("first"), F.max_by(F.struct("lat", "lon"), "seq").alias("last"), (F.max("seq") + 1).alias("seq"))
        known = known.unionByName(ring.where("first <> last").select("way_id", "seq", "first.lat", "first.lon"))
    rows = scratch(known.withColumn("id", F.xxhash64("way_id", "seq")), "vertices")
    distinct_places = rows.groupBy("lat", "lon").agg(F.min("id").alias("id"))
    at = _nearest(distinct_places, lookup, spacing).join(distinct_places, "id").drop("id")
    w = Window.partitionBy("way_id").orderBy("seq")
    v = rows.join(at, ["lat", "lon"]).withColumn("out", F.col("off") > limit)
    for name, lag in (("before", F.lag), ("after", F.lead)):
        for c in ("out", "lat", "lon"):
            v = v.withColumn(f"{c}_{name}", lag(c).over(w))
    v = scratch(v, "located")
    inside = v.where("not out").select("way_id", "seq", F.lit(0).alias("turn"), "y", "x")
    # an outer vertex next to an inner one: the end of a part, the beginning of one, or both
    ends = v.where("out and out_before = false").select("way_id", "seq", F.lit(1).alias("turn"), "lat", "lon", F.col("lat_before").alias("lat_in"), F.col("lon_before").alias("lon_in"), "lat_p", "lon_p")
    # of a line, a vertex that ends a part does not begin the next one too
    starts = F.expr("out and out_after = false") & (F.lit(True) if closed else F.coalesce(F.col("out_before"), F.lit(True)))
    begins = v.where(starts).select("way_id", "seq", F.lit(2).alias("turn"), "lat", "lon", F.col("lat_after").alias("lat_in"), F.col("lon_after").alias("lon_in"), "lat_p", "lon_p")
    edge = ends.unionByName(begins)
    far = lambda p, q: F.hypot(F.col(f"lat{p}") - F.col(f"lat{q}"), F.col(f"lon{p}") - F.col(f"lon{q}"))
    # along the edge from one end as far as the pixel nearest to the outer vertex is away, over the cosine of the angle between;
    # a ring that comes in is measured from the inner end
    inner = (F.col("turn") == 2) & F.lit(closed)
    b, c = F.when(inner, far("_in", "_p")).otherwise(far("", "_p")), far("", "_in")
    a = F.when(inner, far("", "_p")).otherwise(far("_in", "_p"))
    cosine = (b * b + c * c - a * a) / F.nullif(2 * b * c, F.lit(0.0))
    share = F.coalesce(F.least(F.when(cosine > 0, b / cosine / c).otherwise(1.0), F.lit(1.0)), F.lit(0.0))
    share = F.when(inner, 1 - share).otherwise(share)
    cut = edge.select("way_id", "seq", "turn", (F.col("lat") + (F.col("lat_in") - F.col("lat")) * share).alias("lat"), (F.col("lon") + (F.col("lon_in") - F.col("lon")) * share).alias("lon"))
    cut = scratch(cut.withColumn("id", F.xxhash64("way_id", "seq", "turn")), "edges")
    border = cut.select("way_id", "seq", "turn", "id").join(_nearest(cut, lookup, spacing), "id").select("way_id", "seq", "turn", "y", "x")
    whole = inside.unionByName(border)
    order = Window.partitionBy("way_id").orderBy("seq", "turn")
    if closed:
        return whole.select("way_id", F.lit(0).alias("part"), (F.row_number().over(order) - 1).alias("seq"), "y", "x")
    # a part begins where one comes in, or where the way does
    parted = whole.withColumn("begins", (F.col("turn") == 2) | F.lag("turn").over(order).isNull() | (F.lag("turn").over(order) == 1))
    parted = parted.withColumn("part", F.sum(F.col("begins").cast("int")).over(order) - 1)
    return parted.select("way_id", "part", (F.row_number().over(Window.partitionBy("way_id", "part").orderBy("seq", "turn")) - 1).alias("seq"), "y", "x")


def mask(places: DataFrame, lookup: DataFrame, closed: bool, width: float = 1.0) -> DataFrame:
    """(y, x): the pixels of a lookup table (y, x, lat, lon) that lie on the ways (way_id, seq, lat, lon): within `width` / 2 of lines, or
    inside of closed ways and on their edges. No ways raise ValueError."""
    if places.isEmpty():
        raise ValueError("there are no ways")
    parts = scratch(in_image(places, lookup, closed), "parts").withColumn("way_id", F.concat_ws(":", F.col("way_id").cast("string"), F.col("part").cast("string")))
    pixels = lookup.select((F.col("y").cast("long") * (1 << 31) + F.col("x")).alias("point_id"), "y", "x")
    corners = parts.select("way_id", "seq", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    if not closed:
        return along_ways(pixels, _with_single(corners), max(width, 1.0) / 2).select("y", "x")
    return in_polygons(pixels, corners).select("y", "x").unionByName(parts.select("y", "x")).distinct()


def _with_single(corners: DataFrame) -> DataFrame:
    """Lines of one vertex become edges of no length."""
    n = corners.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))
    more = corners.join(n.where("n = 1"), "way_id").select("way_id", (F.col("seq") + 1).alias("seq"), "y", "x")
    return corners.unionByName(more)
