"""Every query of the catalog against its SQL, and the network's known cases."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fringelake.operators import estimation, network, pixels
from fringelake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    for c in columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(), b[c].to_numpy(), atol=2e-6)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("tbase,links,most,pairs", [
    ([0, 6, 12, 18], 2, 12, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]),
    ([0, 12, 18, 312], 3, 5, [(0, 1), (1, 2), (2, 3)]),
    ([0, 12, 18, 312], 3, 20, [(0, 1), (0, 2), (1, 2), (2, 3)]),
])
def test_small_baseline(spark, tbase, links, most, pairs):
    acq = spark.createDataFrame([(i, float(t)) for i, t in enumerate(tbase)], "idx int, tbase double")
    assert sorted((r.first, r.second) if not callable(r.first) else (r["first"], r["second"]) for r in network.small_baseline(acq, links, most).collect()) == pairs


def test_inversion_recovers_time_series(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    truth = [0.0, 0.4, -1.0, 2.0]
    ifg = spark.createDataFrame([(7, i, truth[a] - truth[b]) for i, (a, b) in enumerate(pairs)], "point_id long, ifg int, phase double")
    got = {r.img: r.phase for r in estimation.invert(ifg, pairs, 4).collect()}
    assert all(abs(got[i] - t) < 1e-9 for i, t in enumerate(truth))


def test_nan_is_not_selected(spark):
    rows = spark.createDataFrame([(1, float("nan")), (2, 0.9), (3, 0.1)], "point_id long, gamma double")
    assert [r.point_id for r in pixels.at_least(rows, "gamma", 0.5).collect()] == [2]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
