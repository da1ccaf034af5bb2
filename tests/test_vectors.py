"""Vector files: what is written is read back, in parts, whatever writes them."""

import json

import pytest
from pyspark.errors import PySparkException

from fringelake.plans.steps import as_features
from fringelake.sources import vectors


def _rows(df):
    plain = lambda r: (r.kind, r.geometry and [[(p.x, p.y) for p in part] for part in r.geometry], dict(r.properties))
    return sorted((plain(r) for r in df.collect()), key=str)


def _table(spark, kind, parts_of):
    rows = [(kind, [[{"x": float(x), "y": float(y)} for x, y in part] for part in parts_of(i)], {"id": str(i), "name": f"n {i} é" if i % 3 else None}) for i in range(40)]
    return spark.createDataFrame(rows, vectors.SCHEMA)


KINDS = {
    "Point": lambda i: [[(i, i / 3)]],
    "LineString": lambda i: [[(i + k, k * 1.5) for k in range(2 + i % 4)]],
    "Polygon": lambda i: [[(0, 0), (0, i + 1), (i + 1, 0), (0, 0)], [(0.1, 0.1), (0.2, 0.1), (0.1, 0.2), (0.1, 0.1)]],
    "MultiPoint": lambda i: [[(k, i) for k in range(1 + i % 3)]],
}


@pytest.mark.parametrize("layout", ["geojson", "shp"])
@pytest.mark.parametrize("kind", KINDS)
def test_round_trip(spark, tmp_path, kind, layout):
    table, path = _table(spark, kind, KINDS[kind]), str(tmp_path / "out")
    vectors.write(table.repartition(3), path, layout)
    got = vectors.read(spark, path, layout=layout, split=200)
    assert got.rdd.getNumPartitions() > 3 and _rows(got) == _rows(table)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert all(n.startswith("part-") for n in names) and len(names) == (3 if layout == "geojson" else 9)
    vectors.write(table.limit(5).coalesce(1), path, layout, "append")
    assert vectors.read(spark, path, layout=layout).count() == 45
    vectors.write(table.limit(2).coalesce(1), path, layout)
    assert vectors.read(spark, path, layout=layout).count() == 2


def test_other_layouts_and_odd_features(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1], [0, 0]]], [[[5, 5], [6, 5], [5, 6], [5, 5]]]]}, "properties": {"a": 1, "b": [1, 2], "c": None}},
                {"type": "Feature", "geometry": None, "properties": None}, {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2, 9], [3, 3, 9]]]}, "properties": {}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = _rows(vectors.read(spark, str(tmp_path / "a.geojson"), split=10))
    assert len(got) == 3 and ("MultiPolygon", [[(0, 0), (1, 0), (0, 1), (0, 0)], [(5, 5), (6, 5), (5, 6), (5, 5)]], {"a": "1", "b": "[1, 2]", "c": None}) in got
    assert (None, None, {}) in got
    vectors.write(vectors.read(spark, str(tmp_path / "a.geojson")).where("kind = 'MultiLineString' or kind is null").coalesce(1), str(tmp_path / "s"), "shp")
    assert [k for k, _, _ in _rows(vectors.read(spark, str(tmp_path / "s"), layout="shp"))] == ["MultiLineString", None]


def test_failed_writes_leave_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    vectors.write(_table(spark, "Point", KINDS["Point"]), path, "shp")
    mixed = _table(spark, "Point", KINDS["Point"]).unionByName(_table(spark, "LineString", KINDS["LineString"])).coalesce(1)
    long = spark.createDataFrame([("Point", [[{"x": 0.0, "y": 0.0}]], {"a": "x" * 300})], vectors.SCHEMA)
    for bad in (mixed, long):
        with pytest.raises(PySparkException):
            vectors.write(bad, path, "shp")
    assert vectors.read(spark, path, layout="shp").count() == 40
    vectors.write(spark.createDataFrame([], vectors.SCHEMA), path, "shp")
    assert vectors.read(spark, path, layout="shp").count() == 0


def test_export_rows_as_features(spark, tmp_path):
    rows = spark.createDataFrame([(7, 3, 4, 500000.5, 1.25, -2.0, 0.9, 1.5, None, 3.0, 0.25)], "point_id long, y int, x int, easting double, northing double, velocity double, coherence double, omega double, st_consist double, dem_error double, D20200101 double")
    vectors.write(as_features(rows), str(tmp_path / "e"), "shp")
    kind, place, values = _rows(vectors.read(spark, str(tmp_path / "e"), layout="shp"))[0]
    assert (kind, place) == ("Point", [[(500000.5, 1.25)]])
    assert set(values) == {"point_id", "velocity", "coherence", "omega", "st_consist", "dem_error", "D20200101"} and values["st_consist"] is None and float(values["D20200101"]) == 0.25
