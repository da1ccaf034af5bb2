"""Raster tables in tiles: a tile is a folder, so a box reads the files of its own tiles, and a block is rewritten alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import morton


def tile_of(y: Column, x: Column, size: int) -> Column:
    """The Morton number of the tile of `size` by `size` pixels in which a pixel lies; pixels count from 0."""
    return morton(F.floor(y / size), F.floor(x / size))


def _number(row: int, column: int) -> int:
    return sum((row >> b & 1) << (2 * b + 1) | (column >> b & 1) << (2 * b) for b in range(20))


def box_of(corners: tuple[int, ...]) -> tuple[int, int, int, int]:
    """The box (first y, first x, end y, end x) of corners (x, y, end x, end y), or of (x, y, z, end x, end y, end z), whose z
    is that of a filter on images. ValueError for any other number of corners."""
    if len(corners) not in (4, 6):
        raise ValueError(f"a box has 4 or 6 numbers, not {len(corners)}")
    half = len(corners) // 2
    return corners[1], corners[0], corners[half + 1], corners[half]


def write(pixels: DataFrame, path: str, size: int, mode: str = "overwrite") -> None:
    """Write pixels (y, x and whatever else) in tiles of `size` pixels, each with its rows in order, so that row groups hold ranges of
    y. Tiles that pixels do not touch stay as they are; so a block of the raster is rewritten by writing the tiles that it
    covers in full."""
    tiled = pixels.withColumn("tile", tile_of(F.col("y"), F.col("x"), size))
    rows = tiled.repartition("tile").sortWithinPartitions("tile", "y", "x")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(path)


def read(spark: SparkSession, path: str, size: int, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The pixels of a table of write(), or those of a box (first y, first x, end y, end x; ends excluded). The box becomes a filter
    on tiles, which chooses folders, and on y and x, which reaches the row groups. An empty box has no pixels."""
    table = spark.read.parquet(path)
    if box is None:
        return table.drop("tile")
    y0, x0, y1, x1 = box
    if y1 <= y0 or x1 <= x0:
        return table.where("false").drop("tile")
    rows, columns = range(max(y0, 0) // size, (y1 - 1) // size + 1), range(max(x0, 0) // size, (x1 - 1) // size + 1)
    numbers = [_number(r, c) for r in rows for c in columns]
    # many tiles are a range of Morton numbers, of which the filters on y and x take away what lies beside the box
    chosen = F.col("tile").isin(numbers) if len(numbers) <= 1000 else F.col("tile").between(min(numbers), max(numbers))
    return table.where(chosen & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).drop("tile")
