"""Units, ranges of images and boxes given by their corners."""

import pytest
from pyspark.sql import functions as F

from fringelake.functions import phase
from fringelake.sources import tiles


def test_units(spark):
    rows = spark.createDataFrame([(0.25,), (None,)], "d double")
    for unit, want in (("mm", 250.0), ("cm", 25.0), ("dm", 2.5), ("m", 0.25)):
        assert [r[0] for r in rows.select(phase.in_unit(F.col("d"), unit)).collect()] == [want, None]
    with pytest.raises(ValueError, match="inch"):
        phase.in_unit(F.col("d"), "inch")


def test_image_ranges(spark):
    rows = spark.createDataFrame([(p, k) for p in range(2) for k in range(7)], "point_id long, k int")
    whole = list(range(7))
    for a, b in ((0, 7), (2, 5), (-3, 7), (1, -2), (-9, 2), (5, 2), (7, 9), (-2, -1)):
        got = sorted(r.k for r in phase.images_between(rows, a, b).where("point_id = 0").collect())
        assert got == whole[a:b], (a, b)
    assert phase.images_between(rows.where("false"), -2, 3).count() == 0


def test_box_of_corners(spark, tmp_path):
    assert tiles.box_of((3, 1, 9, 5)) == tiles.box_of((3, 1, 0, 9, 5, 4)) == (1, 3, 5, 9)
    with pytest.raises(ValueError):
        tiles.box_of((1, 2, 3))
    tiles.write(spark.createDataFrame([(y, x) for y in range(8) for x in range(12)], "y int, x int"), str(tmp_path / "t"), 4)
    got = {(r.y, r.x) for r in tiles.read(spark, str(tmp_path / "t"), 4, tiles.box_of((3, 1, 9, 5))).collect()}
    assert got == {(y, x) for y in range(1, 5) for x in range(3, 9)}
