"""The processing steps on a simulated stack, and the configuration."""

import datetime

import numpy as np
import pytest

from fringelake import config
from fringelake.plans import steps

WAVELENGTH = 0.0556


def test_configuration():
    c = config.parse('{/* all */ "preparation": {"num_ifgs": 2, "start_date": "", // open\n "end_date": "2021-03-01",}, "filtering": {"interpolation_method": "Kriging"},}')
    assert (c.preparation.num_ifgs, c.preparation.start_date, c.preparation.max_tbase, c.filtering.interpolation_method) == (2, None, 100, "kriging")
    assert config.parse(config.Config().as_json()) == config.Config()
    for bad in ('{"preparation": {"num_ifgs": 0}}', '{"preparation": {"ifg_network_type": "x"}}', '{"filtering": {"coherence_p2": 1.5}}', '{"x": {}}', '{"filtering": {"x": 1}}', '{"preparation": {"start_date": "2021-02-30"}}', '{"consistency_check": {"max_arc_length": -1}}'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_steps_find_what_was_simulated(spark):
    r = np.random.default_rng(11)
    rows, cols, images = 8, 9, 10
    y, x = np.divmod(np.arange(rows * cols), cols)
    t, base = np.arange(images) * 36.0, r.uniform(-150, 150, images)
    vel, dem = 0.012 * (x - 4) / 4, 6 * np.sin(y)
    scale = 4 * np.pi / WAVELENGTH
    inc, distance = 0.55 + 0.02 * x, 850000.0 + 4000 * y
    # a rest of more than half a cycle over the image, another plane in each
    columns = np.stack([np.ones(images), t / 100, base / 100], axis=1)
    of_y, of_x = (c - columns @ np.linalg.lstsq(columns, c, rcond=None)[0] for c in r.uniform(-0.5, 0.5, (2, images)))  # neither velocity nor elevation error
    plane = np.outer(y - 3.5, of_y) + np.outer(x - 4, of_x)
    phase = scale * (np.outer(vel, t / 365.25) + np.outer(dem / (distance * np.sin(inc)), base)) + plane + 0.05 * r.standard_normal((rows * cols, images))
    assert np.ptp(plane, axis=0).max() > np.pi
    truth = phase.copy()
    phase += r.uniform(-np.pi, np.pi, images)  # an image's own offset
    bad = 40  # a pixel of noise only
    phase[bad] = r.uniform(-np.pi, np.pi, images)
    day = datetime.date(2020, 1, 1)
    acq = spark.createDataFrame([(i, day + datetime.timedelta(t[i]), float(t[i]), float(base[i])) for i in range(images)], "idx int, date date, tbase double, pbase double")
    points = spark.createDataFrame([(i, int(y[i]), int(x[i]), float(inc[i]), float(distance[i])) for i in range(rows * cols)], "point_id long, y int, x int, inc double, slant_range double")
    slc = spark.createDataFrame([(p, i, float(np.cos(phase[p, i])), float(np.sin(phase[p, i]))) for p in range(rows * cols) for i in range(images)], "point_id long, img int, re double, im double")
    c = config.Config()
    c.preparation.num_ifgs, c.preparation.filter_window_size = 3, 3
    c.consistency_check = config.ConsistencyCheck(0.5, 2, 4, None, 0.05, 20.0, 40, 0.6, 0.6)
    c.filtering = config.Filtering(0.4, True, "kriging", 3, 1.0)
    c.densification = config.Densification(3, 2000, 0.05, 20.0, 40, 0.6)

    prepared = steps.preparation(slc, acq, points, c)
    assert prepared.coherence.count() == rows * cols and prepared.network.count() >= 2 * images - 3
    checked = steps.consistency_check(prepared, points, c, WAVELENGTH)
    first = {p.point_id for p in checked.points.collect()}
    assert 10 <= len(first) <= 20 and bad not in first
    unwrapped = steps.unwrapping(prepared, checked, points, WAVELENGTH)
    got = {p.point_id: p for p in unwrapped.parameters.collect()}
    ref = min(first)
    assert set(got) == first and all(abs(got[p].vel - (vel[p] - vel[ref])) < 0.03 and abs(got[p].demerr - (dem[p] - dem[ref])) < 3 for p in first)
    series = np.zeros((rows * cols, images))
    for s in unwrapped.series.collect():
        series[s.point_id, s.k] = s.phase
    p = sorted(first - {ref})
    want = truth[p] - truth[ref] - (truth[p, :1] - truth[ref, :1])
    assert np.abs(want - (truth[p] - truth[p, :1] - plane[p] + plane[p, :1] - (truth[ref] - truth[ref, :1] - plane[ref] + plane[ref, :1]))).max() > np.pi
    assert np.abs(series[p] - series[ref] - want).max() < 1  # no cycle is missed
    filtered = steps.filtering(prepared, checked, unwrapped, points, c, WAVELENGTH, 6)
    assert filtered.series.count() == len(first) * images and filtered.points.count() > len(first)
    dense = steps.densification(prepared, checked, unwrapped, filtered, points, c, WAVELENGTH)
    got = {p.point_id: p for p in dense.parameters.collect()}
    assert len(got) > 50 and all(abs(got[p].vel - (vel[p] - vel[ref])) < 0.03 for p in got if p != bad)
    out = steps.exported(prepared, dense, points, WAVELENGTH).toPandas()
    assert len(out) == len(got) and sum(n.startswith("D2020") for n in out.columns) == images
    v = dict(zip(out.point_id, out.velocity))
    assert all(abs((v[p] - v[ref]) / 1000 - (vel[p] - vel[ref])) < 0.006 for p in v if p != bad)
    assert out.st_consist.notna().all() and (out.st_consist < 20).all()


def test_dates(spark):
    acq = spark.createDataFrame([(i, datetime.date(2020, 1, 1 + i), float(i), 0.0) for i in range(5)], "idx int, date date, tbase double, pbase double")
    assert steps.within_dates(acq, None, None).count() == 5 and steps.within_dates(acq, "2020-01-02", "2020-01-04").count() == 3
    for first, last in (("2020-02-01", None), (None, "2019-12-31")):
        with pytest.raises(ValueError):
            steps.within_dates(acq, first, last)


def test_points_of_second_order(spark):
    points = spark.createDataFrame([(i, i, 0) for i in range(12)], "point_id long, y int, x int")
    gamma = spark.createDataFrame([(i, 0.9 if i < 3 else 0.2 if i != 3 else float("nan")) for i in range(12)], "point_id long, gamma double")
    amplitude = spark.createDataFrame([(i, 1.0 if i != 2 else None) for i in range(12)], "point_id long, bmap double")
    prepared, checked = steps.Prepared(None, None, None, gamma, amplitude), steps.Checked(points.where("point_id in (0, 11)"), None, None)
    linked = spark.createDataFrame([(5, 0.9, 30, False), (6, 0.9, 5, False), (7, 0.8, 30, False), (8, 0.1, 1, True), (9, 0.95, 21, False)], "point_id long, coherence double, siblings int, persistent boolean")
    c = config.Config()

    def found(**given):
        return sorted(r.point_id for r in steps.second_order_points(prepared, checked, points, c, **given).collect())

    assert found() == [0, 1, 11] and found(linked=linked) == [0, 1, 11] and found(mask=points.where("point_id < 5")) == [0, 1]
    c.phase_linking.use_phase_linking_results = True
    assert found(linked=linked) == [0, 1, 5, 9, 11]  # 0.8 is not above the limit, five siblings are too few
    assert found(linked=linked, linked_mask=points.where("point_id > 5")) == [0, 1, 9, 11]
    c.phase_linking.use_ps = True
    assert found(linked=linked) == [0, 1, 5, 6, 8, 9, 11]
    with pytest.raises(ValueError):
        found()
