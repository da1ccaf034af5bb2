"""The command line: configurations, stored steps, masks, ways and exports."""

import json
import math

import pytest

from fringelake import cli, config
from fringelake.plans import steps
from fringelake.sources import vectors


def test_config(tmp_path, capsys):
    cli.main(["config", "-o", str(tmp_path / "c.json")])
    assert config.load(str(tmp_path / "c.json")) == config.Config()
    (tmp_path / "d.json").write_text('{"general": {"output_path": "x"}, // here\n}')
    cli.main(["config", "-f", str(tmp_path / "d.json")])
    said = json.loads(capsys.readouterr().out)
    assert said["general"]["output_path"] == "x" and set(said) == {"general", "phase_linking", "preparation", "consistency_check", "unwrapping", "filtering", "densification"}
    for bad in ('{"general": {"spatial_unwrapping_method": "x"}}', '{"general": {"logging_level": "LOUD"}}', '{"phase_linking": {"num_siblings": 0}}', '{"filtering": {"interpolation_method": "cubic"}}'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_steps_are_stored_and_resumed(spark, tmp_path, monkeypatch):
    c = config.Config()
    c.general.input_path, c.general.output_path = str(tmp_path / "in"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        cli.run(spark, c, 0.05)
    for n in cli.INPUTS:
        spark.range(3).withColumnRenamed("id", "point_id").write.parquet(f"{tmp_path}/in/{n}.parquet")
    called = []

    def fake(name, kind):
        def step(*given, **named):
            called.append((name, [type(x).__name__ for x in given if isinstance(x, tuple)]))
            return kind(*[spark.range(len(called)) for _ in kind._fields])

        return step

    for name, kind in cli.STEPS:
        monkeypatch.setattr(steps, name, fake(name, kind))
    with pytest.raises(FileNotFoundError, match="preparation"):
        cli.run(spark, c, 0.05, 1, 1)
    assert not called
    cli.run(spark, c, 0.05, 0, 1)
    cli.run(spark, c, 0.05, 2, 4)
    assert [n for n, _ in called] == [n for n, _ in cli.STEPS] and called[-1][1] == ["Prepared", "Checked", "Unwrapped", "Filtered"]
    assert cli.load(spark, str(tmp_path / "out"), "unwrapping").series.count() == 3
    cli.run(spark, c, 0.05, 2, 2)
    assert cli.load(spark, str(tmp_path / "out"), "unwrapping").series.count() == 6
    for first, last in ((-1, 2), (3, 2), (0, 5)):
        with pytest.raises(ValueError):
            cli.run(spark, c, 0.05, first, last)


def test_masks_and_ways(spark, tmp_path):
    lookup = [(y, x, 50 + y * 0.001, 10 + x * 0.001) for y in range(6) for x in range(6)]
    spark.createDataFrame(lookup, "y int, x int, lat double, lon double").write.parquet(f"{tmp_path}/lookup")
    spark.createDataFrame([(i, 50 + 0.001 * i, 10.002) for i in range(4)], "node_id long, lat double, lon double").write.parquet(f"{tmp_path}/nodes")
    spark.createDataFrame([(1, {"railway": "rail"}, [0, 2]), (2, {"highway": "track"}, [1])], "way_id long, tags map<string,string>, refs array<long>").write.parquet(f"{tmp_path}/ways")
    cli.main(["ways", f"{tmp_path}/nodes", f"{tmp_path}/ways", "--box", "49", "9", "51", "11", "--kinds", "rail", "-o", f"{tmp_path}/found"], spark)
    row = vectors.read(spark, f"{tmp_path}/found").first()
    assert row.kind == "LineString" and [(p.x, p.y) for p in row.geometry[0]] == [(10.002, 50.0), (10.002, 50.002)] and row.properties == {"railway": "rail"}
    cli.main(["mask", f"{tmp_path}/found", "--lookup", f"{tmp_path}/lookup", "-w", "1", "-o", f"{tmp_path}/mask"], spark)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/mask").select("y", "x").collect())) == [(0, 2), (1, 2), (2, 2)]
    with pytest.raises(TypeError):
        cli.vertices_of(spark.createDataFrame([("Point", [[{"x": 1.0, "y": 2.0}]], {})], vectors.SCHEMA))


def test_heading(spark):
    meta = spark.createDataFrame([("WAVELENGTH", "0.05"), ("Heading", "-168.5")], "key string, value string")
    assert cli.heading_of(meta) == pytest.approx(math.radians(-168.5))
    with pytest.raises(KeyError):
        cli.heading_of(meta.where("key = 'WAVELENGTH'"))
