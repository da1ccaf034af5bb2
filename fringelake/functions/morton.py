"""Morton order of places: the bits of two coordinates in turn, so that places near in the order are near in the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, scratch

#: Bits of each coordinate.
BITS = 20


def _spread(c: Column) -> Column:
    """The bits of a number under 2**20 with a zero between each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(row: Column, column: Column) -> Column:
    """The number of a place with whole coordinates from 0 to 2**20 - 1."""
    return F.shiftleft(_spread(row.cast("long")), 1).bitwiseOR(_spread(column.cast("long")))


def ranked(points: DataFrame) -> DataFrame:
    """(point_id, rank): the rank, from 0, of each point (point_id, y, x) in Morton order, then by id. The points are sorted over
    all partitions, and each partition's first rank comes from the sizes of those before it."""
    edge = points.agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")).cast("double").alias("size"))
    step = lambda c, lo: F.least(F.floor((F.col(c) - F.col(lo)) / F.greatest("size", F.lit(1e-300)) * 2**BITS), F.lit(2**BITS - 1))
    placed = points.join(F.broadcast(edge)).select("point_id", morton(step("y", "y0"), step("x", "x0")).alias("place"))  # one row
    sorted_rows = placed.repartitionByRange("place", "point_id").sortWithinPartitions("place", "point_id")
    kept = scratch(sorted_rows.select("point_id", F.monotonically_increasing_id().alias("n")), "order")
    part = F.shiftright("n", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", F.expr("sum(size) over (order by part) - size").alias("before"))  # one row for each partition
    out = kept.withColumn("part", part).join(F.broadcast(before), "part").select("point_id", (F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    out = scratch(out, "ranks")
    discard(kept)
    return out
