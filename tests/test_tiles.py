"""Tiled rasters: which files a box reads, and what is rewritten."""

import re

from pyspark.sql import functions as F

from fringelake.sources import tiles


def _files(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return df.select(F.input_file_name().alias("f")).distinct().count(), text, plan


def test_box_reads_its_tiles(spark, tmp_path):
    pixels = spark.range(40 * 30).select((F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), (F.col("id") * 2).cast("double").alias("v"))
    path = str(tmp_path / "raster")
    tiles.write(pixels, path, 8)
    assert sorted(map(tuple, tiles.read(spark, path, 8).select("y", "x", "v").collect())) == sorted(map(tuple, pixels.collect()))
    for box in ((3, 5, 12, 9), (0, 0, 1, 1), (39, 29, 99, 99), (8, 8, 16, 16), (-5, -5, 3, 3)):
        got = tiles.read(spark, path, 8, box)
        want = pixels.where(f"y >= {box[0]} and x >= {box[1]} and y < {box[2]} and x < {box[3]}")
        assert sorted(map(tuple, got.select("y", "x", "v").collect())) == sorted(map(tuple, want.collect()))
        folders = {re.search(r"tile=(\d+)", r.f)[1] for r in spark.read.parquet(path).where(F.col("tile").isin([int(t.tile) for t in want.select(tiles.tile_of(F.col("y"), F.col("x"), 8).alias("tile")).distinct().collect()])).select(F.input_file_name().alias("f")).distinct().collect()}
        count, plan, _ = _files(got)
        assert count == len(folders) and "PartitionFilters: [isnotnull(tile" in plan or "tile" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert tiles.read(spark, path, 8, (5, 5, 5, 9)).count() == 0
    assert _files(tiles.read(spark, path, 8, (0, 0, 8, 8)))[0] == 1


def test_block_is_rewritten_alone(spark, tmp_path):
    pixels = spark.range(16 * 16).select((F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"), F.lit(0).alias("v"))
    path = str(tmp_path / "raster")
    tiles.write(pixels, path, 8)
    tiles.write(pixels.where("y < 8 and x >= 8").withColumn("v", F.lit(7)), path, 8)
    got = tiles.read(spark, path, 8)
    assert got.count() == 256 and got.where("v = 7").count() == 64 and got.where("v = 7 and (y >= 8 or x < 8)").count() == 0
