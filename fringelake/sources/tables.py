"""Tables read as points, phases, acquisitions and time series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phase import wrap

#: Columns of the pixel lattice on which the vectors of `embeddings` lie.
WIDTH = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, y, x, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.floor(F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), "label")


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, k, phase): one wrapped phase for each point and epoch."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.posexplode("embedding").alias("k", "value"))
    return e.select("point_id", "k", wrap(F.col("value").cast("double") * math.pi).alias("phase"))


def complex_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, img, re, im): neighbouring vector elements as a complex sample of image img."""
    pairs = F.expr("transform(sequence(0, size(embedding) div 2 - 1), i -> struct(i as img, double(embedding[2 * i]) as re, double(embedding[2 * i + 1]) as im))")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.inline(pairs))


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, date, tbase in days, pbase in metres): every order date is one; pbase is made up from the day. One row for each
    image: few, as days are."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    n = d.select((F.expr("row_number() over (order by date)") - 1).cast("int").alias("idx"), "date", F.expr("datediff(date, min(date) over ())").cast("double").alias("tbase"))
    return n.withColumn("pbase", F.expr("(tbase * 37) % 401 - 200").cast("double"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, height, inc, slant_range) from part: height in metres, incidence in radians, slant range in metres."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("height"), (F.lit(0.5) + F.col("p_size") / 500).alias("inc"), (F.lit(850000.0) + F.col("p_retailprice")).alias("slant_range"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, id, t in years since 2024, value) from events."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("point_id"), F.col("event_id").alias("id"), ((micros - F.lit(1704067200000000)) / F.lit(31557600000000.0)).alias("t"), "value")
