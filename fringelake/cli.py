"""Command line: configurations, the processing steps with stored results, masks from vector files, and exports.

    python -m fringelake.cli config -o config.json             write the defaults
    python -m fringelake.cli run -f config.json 0 2             steps 0 to 2
    python -m fringelake.cli export outputs -o points --layout shp
    python -m fringelake.cli mask ways.geojson --lookup lookup.parquet -o mask.parquet
    python -m fringelake.cli ways nodes.parquet ways.parquet --box 48 11 49 12 --kinds motorway rail -o ways

A step's tables are stored as Parquet in the output folder, one folder for each table, so a later run goes on from them.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as cfg
from .operators import ways as wy
from .plans import steps
from .sources import vectors

#: The steps in order, what each returns, and the name under which its tables are stored.
STEPS = [("preparation", steps.Prepared), ("consistency_check", steps.Checked), ("unwrapping", steps.Unwrapped), ("filtering", steps.Filtered), ("densification", steps.Densified)]
INPUTS = ("slc", "acquisitions", "points")


def _path(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])


def store(result, folder: str, step: str) -> None:
    """Write the tables of a step's result; those of an earlier run are replaced."""
    for name, table in result._asdict().items():
        table.write.mode("overwrite").parquet(_path(folder, step, name))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def required(spark: SparkSession, paths: list[str]) -> None:
    """Raise FileNotFoundError that names the tables which are not there."""
    if missing := [p for p in paths if not _exists(spark, p)]:
        raise FileNotFoundError(f"results of earlier steps are missing: {', '.join(missing)}")


def load(spark: SparkSession, folder: str, step: str):
    """The stored result of a step."""
    kind = dict(STEPS)[step]
    required(spark, [_path(folder, step, f) for f in kind._fields])
    return kind(*[spark.read.parquet(_path(folder, step, f)) for f in kind._fields])


def run(spark: SparkSession, config: cfg.Config, wavelength: float, first: int = 0, last: int = 4) -> None:
    """Run the steps from first to last, both included, on the tables of the input folder (slc, acquisitions, points). Steps before the
    first must be stored in the output folder, whatever steps are in the run; if some are not, FileNotFoundError comes before
    anything is computed."""
    if not 0 <= first <= last < len(STEPS):
        raise ValueError(f"steps are 0 to {len(STEPS) - 1}: {first} to {last}")
    out = config.general.output_path
    inputs = [_path(config.general.input_path, f"{n}.parquet") for n in INPUTS]
    p = config.phase_linking
    named = {"p1": config.consistency_check.mask_p1_file, "p2": config.filtering.mask_p2_file}
    if p.use_phase_linking_results:
        named |= {"linked": _path(p.inverted_path, "phase_series.parquet"), "linked_mask": p.mask_phase_linking_file, "persistent": p.mask_ps_file if p.use_ps else None}
    named = {k: v for k, v in named.items() if v}
    required(spark, inputs + list(named.values()) + [_path(out, n, f) for n, kind in STEPS[:first] for f in kind._fields])
    slc, acquisitions, points = (spark.read.parquet(p) for p in inputs)
    done = {name: load(spark, out, name) for name, _ in STEPS[:first]}
    # masks and results of phase linking are tables of pixels (y, x)
    at = {k: spark.read.parquet(v).join(points.select("point_id", "y", "x"), ["y", "x"]) for k, v in named.items()}
    if "persistent" in at:
        single = at["persistent"].select("point_id", F.lit(True).alias("persistent"))
        at["linked"] = at["linked"].join(single, "point_id", "left").withColumn("persistent", F.coalesce("persistent", F.lit(False)))
    work = {
        "preparation": lambda: steps.preparation(slc, acquisitions, points, config),
        "consistency_check": lambda: steps.consistency_check(done["preparation"], points, config, wavelength, at.get("p1")),
        "unwrapping": lambda: steps.unwrapping(done["preparation"], done["consistency_check"], points, wavelength, config),
        "filtering": lambda: steps.filtering(done["preparation"], done["consistency_check"], done["unwrapping"], points, config, wavelength, linked=at.get("linked"), linked_mask=at.get("linked_mask"), mask=at.get("p2")),
        "densification": lambda: steps.densification(done["preparation"], done["consistency_check"], done["unwrapping"], done["filtering"], points, config, wavelength),
    }
    for name, _ in STEPS[first : last + 1]:
        store(work[name](), out, name)
        done[name] = load(spark, out, name)


def export(spark: SparkSession, config: cfg.Config, wavelength: float, path: str, layout: str, heading: float | None = None, series: bool = True) -> None:
    """Write the rows of the densified points as a vector file; without the series if not asked for."""
    out = config.general.output_path
    points = spark.read.parquet(_path(config.general.input_path, "points.parquet"))
    rows = steps.exported(load(spark, out, "preparation"), load(spark, out, "densification"), points, wavelength, heading)
    if not series:
        rows = rows.drop(*[c for c in rows.columns if c[:1] == "D" and c[1:].isdigit()])
    vectors.write(steps.as_features(rows), path, layout)


def heading_of(meta: DataFrame) -> float:
    """The heading in radians from a table (key, value), whose key may be in any case; KeyError if there is none."""
    row = meta.where(F.lower("key") == "heading").select(F.radians(F.col("value").cast("double")).alias("h")).first()
    if row is None or row.h is None:
        raise KeyError("the metadata have no heading")
    return row.h


def vertices_of(features: DataFrame) -> tuple[DataFrame, bool]:
    """((way_id, seq, lat, lon), whether the ways are closed) of features (kind, geometry, properties) that are all lines or all
    polygons, as the first of them is; other kinds raise TypeError. Of a polygon the outer ring counts."""
    first = features.where("geometry is not null").select("kind").first()
    if first is None or first.kind not in ("LineString", "MultiLineString", "Polygon", "MultiPolygon"):
        raise TypeError(f"only lines and polygons make masks, not {first and first.kind}")
    closed = first.kind.endswith("Polygon")
    some = features.where(F.col("kind").endswith("Polygon") if closed else F.col("kind").endswith("LineString"))
    numbered = some.select(F.monotonically_increasing_id().alias("n"), F.posexplode("geometry").alias("part", "places"))
    numbered = numbered.where("part = 0") if closed else numbered
    return numbered.select(F.concat_ws(":", F.col("n").cast("string"), F.col("part").cast("string")).alias("way_id"), F.posexplode("places").alias("seq", "p")).select("way_id", "seq", F.col("p.y").alias("lat"), F.col("p.x").alias("lon")), closed


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fringelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("config", help="write the defaults, or show a configuration with them")
    c.add_argument("-f", "--file")
    c.add_argument("-o", "--output")
    for name in ("run", "export"):
        c = commands.add_parser(name)
        c.add_argument("-f", "--file", required=True, help="the configuration")
        c.add_argument("--wavelength", type=float, required=True, help="in metres")
    commands.choices["run"].add_argument("first", type=int)
    commands.choices["run"].add_argument("last", type=int)
    c = commands.choices["export"]
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--layout", choices=("shp", "geojson"), default="shp")
    c.add_argument("-g", "--correct-geolocation", metavar="META", help="a table (key, value) with the heading")
    c.add_argument("-t", "--no-time-series", action="store_true")
    c = commands.add_parser("mask")
    c.add_argument("input")
    c.add_argument("--lookup", required=True, help="a table (y, x, lat, lon)")
    c.add_argument("-w", "--width", type=float, default=6)
    c.add_argument("-o", "--output", required=True)
    c = commands.add_parser("ways")
    c.add_argument("nodes")
    c.add_argument("ways")
    c.add_argument("--box", type=float, nargs=4, required=True, metavar=("SOUTH", "WEST", "NORTH", "EAST"))
    c.add_argument("--kinds", nargs="*", default=[])
    c.add_argument("--bridges", nargs="*", choices=("highway", "railway"))
    c.add_argument("-o", "--output", required=True)
    a = parser.parse_args(arguments)
    if a.command == "config":
        text = (cfg.load(a.file) if a.file else cfg.Config()).as_json()
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
        return
    spark = spark or SparkSession.builder.appName("fringelake").getOrCreate()
    if a.command == "run":
        run(spark, cfg.load(a.file), a.wavelength, a.first, a.last)
    elif a.command == "export":
        heading = heading_of(spark.read.parquet(a.correct_geolocation)) if a.correct_geolocation else None
        export(spark, cfg.load(a.file), a.wavelength, a.output, a.layout, heading, not a.no_time_series)
    elif a.command == "mask":
        places, closed = vertices_of(vectors.read(spark, a.input))
        wy.mask(places, spark.read.parquet(a.lookup), closed, a.width).write.mode("overwrite").parquet(a.output)
    else:
        nodes, ways = spark.read.parquet(a.nodes), spark.read.parquet(a.ways)
        found = wy.infrastructure(ways, nodes, tuple(a.box), a.kinds) if a.bridges is None else wy.bridges(ways, nodes, tuple(a.box), "highway" in a.bridges, "railway" in a.bridges)
        at = wy.vertices(found, nodes).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")))).alias("v"))
        lines = found.join(at, "way_id").select(F.lit("LineString").alias("kind"), F.array(F.transform("v", lambda v: v["p"])).alias("geometry"), F.col("tags").alias("properties"))
        vectors.write(lines, a.output)


if __name__ == "__main__":
    main(sys.argv[1:])
