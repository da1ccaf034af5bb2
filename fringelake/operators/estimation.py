"""Least squares, correlation, references and inversion as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def velocity(series: DataFrame) -> DataFrame:
    """(point_id, slope, offset, omega) of value on t for each point; omega is the sum of squared residuals. Null slope where
    all t are equal. Centred moments, of which partial ones are made in each task."""
    m = {"n": F.count(F.lit(1)), "mt": F.avg("t"), "mv": F.avg("value"), "tt": F.var_pop("t"), "vv": F.var_pop("value"), "tv": F.covar_pop("t", "value")}
    s = series.groupBy("point_id").agg(*[f.alias(name) for name, f in m.items()])
    s = s.withColumn("slope", F.when(F.col("tt") > 0, F.col("tv") / F.col("tt")))
    return s.select("point_id", "slope", (F.col("mv") - F.col("slope") * F.col("mt")).alias("offset"), (F.col("n") * (F.col("vv") - F.col("slope") * F.col("tv"))).alias("omega"))


def residuals(series: DataFrame, fit: DataFrame) -> DataFrame:
    """series with residual, value less the fitted line."""
    return series.join(fit.select("point_id", "slope", "offset"), "point_id").withColumn("residual", F.col("value") - F.col("slope") * F.col("t") - F.col("offset"))


def autocorrelation(series: DataFrame, value: str, order: list[str], lag: int = 1) -> DataFrame:
    """(point_id, autocorrelation): absolute correlation with the value `lag` steps later; null where it is constant."""
    w = Window.partitionBy("point_id").orderBy(*order)
    s = series.withColumn("later", F.lead(value, lag).over(w)).where("later is not null")
    fine = (F.stddev_pop(value) > 0) & (F.stddev_pop("later") > 0)
    cov = F.covar_pop(value, "later")
    return s.groupBy("point_id").agg(F.when(fine, F.abs(cov / (F.stddev_pop(value) * F.stddev_pop("later")))).alias("autocorrelation"))


def peak_members(fits: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows in the fullest of `bins` bins of a value, the lowest of equally full ones; a bin holds its lower edge only."""
    edge = fits.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = fits.join(F.broadcast(edge)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    top = at.groupBy("bin").count().agg(F.min(F.struct((-F.col("count")).alias("c"), "bin")).alias("m")).select(F.col("m.bin").alias("top"))
    return at.join(F.broadcast(top), F.col("bin") == F.col("top")).where((F.col("bin") < bins - 1) | (F.col(value) < F.col("hi"))).drop("lo", "hi", "bin", "top")


def without_epoch_mean(phases: DataFrame) -> DataFrame:
    """Each epoch's mean taken off. The means, one row for each epoch, are joined, so no epoch meets in one task."""
    mean = phases.groupBy("k").agg(F.avg("phase").alias("mean"))
    return phases.join(F.broadcast(mean), "k").select("point_id", "k", (F.col("phase") - F.col("mean")).alias("phase"))


def without_reference(phases: DataFrame, point_id: int) -> DataFrame:
    """The phase of one point taken off at each epoch."""
    ref = phases.where(F.col("point_id") == point_id).select("k", F.col("phase").alias("ref"))
    return phases.join(F.broadcast(ref), "k").select("point_id", "k", (F.col("phase") - F.col("ref")).alias("phase"))


def _best_of(phases: DataFrame, grid: list[tuple[float, ...]], model) -> DataFrame:
    """(point_id, i, gamma): the row of the grid whose model leaves the most coherent residuals; the first of equal ones.

    model(values of a row) is a column over an epoch's row. Each row of the grid is a pair of sums, so a point's epochs are
    read once, and what is shuffled is one row of sums for each point and task."""
    angle = lambda r: F.col("phase") - model(*r)
    sums = [f(angle(r)) for r in grid for f in (F.cos, F.sin)]
    per = phases.groupBy("point_id").agg(*[F.avg(x).alias(f"s{i}") for i, x in enumerate(sums)])
    gamma = [F.round(F.sqrt(F.pow(F.col(f"s{2 * i}"), 2) + F.pow(F.col(f"s{2 * i + 1}"), 2)), 9) for i in range(len(grid))]
    best = F.array_max(F.array(*[F.struct(g.alias("gamma"), F.lit(-i).alias("i")) for i, g in enumerate(gamma)]))
    return per.select("point_id", best.alias("m")).select("point_id", (-F.col("m.i")).alias("i"), "m.gamma")


def grid_search(phases: DataFrame, design: list[float], rates: list[float]) -> DataFrame:
    """(point_id, rate, gamma): the rate of a grid whose model design * rate leaves the most coherent residuals; the first of
    equal ones. Both lists are short."""
    spark = phases.sparkSession
    of = spark.createDataFrame([(k, float(d)) for k, d in enumerate(design)], "k int, design double")
    best = _best_of(phases.join(F.broadcast(of), "k"), [(float(r),) for r in rates], lambda r: F.col("design") * F.lit(r))
    return best.select("point_id", F.get(F.array(*[F.lit(float(r)) for r in rates]), F.col("i")).alias("rate"), "gamma")


def inversion_weights(pairs: list[tuple[int, int]], images: int, reference: int = 0) -> np.ndarray:
    """Images by interferograms: the pseudo-inverse of the design matrix without the reference image, whose row is 0."""
    a = np.zeros((len(pairs), images))
    for i, (p, q) in enumerate(pairs):
        a[i, p], a[i, q] = 1, -1
    keep = [c for c in range(images) if c != reference]
    out = np.zeros((images, len(pairs)))
    out[keep] = np.linalg.pinv(a[:, keep])
    return out


def invert(ifg: DataFrame, pairs: list[tuple[int, int]], images: int, reference: int = 0) -> DataFrame:
    """(point_id, img, phase) from interferograms (point_id, ifg, phase), the i-th of which is pairs[i], in least squares; the
    reference image is 0. Points must have all interferograms.

    A point is one row with an array; a batch of rows is one product with the network's normal equations, of images times images,
    which a task makes from the pairs, so no matrix is sent. Images that the network does not connect get the least of all solutions."""
    rows = ifg.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("ifg", "phase"))).alias("e")).select("point_id", F.col("e.phase").alias("phase"))
    first, second = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal = np.zeros((images, images))
        for i, j, sign in ((first, first, 1), (second, second, 1), (first, second, -1), (second, first, -1)):
            np.add.at(normal, (i, j), sign)
        keep = np.arange(images) != reference
        inverse = np.linalg.pinv(normal[np.ix_(keep, keep)], hermitian=True)
        for b in batches:
            if not len(b):
                continue
            phase = np.stack(b["phase"].to_numpy())
            side = np.zeros((images, len(b)))
            np.add.at(side, first, phase.T)
            np.add.at(side, second, -phase.T)
            out = np.zeros((len(b), images))
            out[:, keep] = (inverse @ side[keep]).T
            yield pd.DataFrame({"point_id": b["point_id"], "series": list(out)})

    series = rows.mapInPandas(run, "point_id long, series array<double>")
    return series.select("point_id", F.posexplode("series").alias("img", "phase"))


def node_median(arcs: DataFrame) -> DataFrame:
    """(point_id, gamma): median over the arcs (src, dst, gamma) at each end."""
    ends = arcs.select(F.col("src").alias("point_id"), "gamma").unionByName(arcs.select(F.col("dst").alias("point_id"), "gamma"))
    return ends.groupBy("point_id").agg(F.median("gamma").alias("gamma"))


def variogram(values: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """(bin, n, semivariance) of values (point_id, value) over pairs (a, b, d2) with a < b, in bins of distance."""
    a, b = (values.select(F.col("point_id").alias(x), F.col("value").alias(f"v{x}")) for x in ("a", "b"))
    p = pairs.where("a < b").join(a, "a").join(b, "b")
    return p.groupBy(F.floor(F.sqrt("d2") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (0.5 * F.avg((F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb")))).alias("semivariance"))


def velocity_and_elevation(series: DataFrame) -> DataFrame:
    """(point_id, demerr, vel, atmosphere) of value on p (elevation error's factor), t and a constant, by the moments of each
    point. Null where p and t do not tell the parameters apart."""
    m = {"pp": F.var_pop("p"), "tt": F.var_pop("t"), "pt": F.covar_pop("p", "t"), "pv": F.covar_pop("p", "value"), "tv": F.covar_pop("t", "value"), "mp": F.avg("p"), "mt": F.avg("t"), "mv": F.avg("value")}
    s = series.groupBy("point_id").agg(*[f.alias(name) for name, f in m.items()])
    det = F.col("pp") * F.col("tt") - F.col("pt") * F.col("pt")
    s = s.withColumn("demerr", F.when(det > 1e-15, (F.col("tt") * F.col("pv") - F.col("pt") * F.col("tv")) / det))
    s = s.withColumn("vel", F.when(det > 1e-15, (F.col("pp") * F.col("tv") - F.col("pt") * F.col("pv")) / det))
    return s.select("point_id", "demerr", "vel", (F.col("mv") - F.col("demerr") * F.col("mp") - F.col("vel") * F.col("mt")).alias("atmosphere"))


def grid_search_two(phases: DataFrame, design: DataFrame, demerr: list[float], vel: list[float]) -> DataFrame:
    """(point_id, demerr, vel, gamma): the pair of a grid whose model leaves the most coherent residuals, the first in order
    of demerr and vel of equal ones. design (k, of_demerr, of_vel) has one row for each epoch, the grid is short."""
    grid = [(float(a), float(b)) for a in demerr for b in vel]
    best = _best_of(phases.join(F.broadcast(design), "k"), grid, lambda a, b: F.col("of_demerr") * F.lit(a) + F.col("of_vel") * F.lit(b))
    at = lambda i: F.get(F.array(*[F.lit(g[i]) for g in grid]), F.col("i"))
    return best.select("point_id", at(0).alias("demerr"), at(1).alias("vel"), "gamma")


def to_histogram_peak(phases: DataFrame, rates: DataFrame, bins: int = 300) -> DataFrame:
    """phases (point_id, k, phase) less, at each epoch, the mean phase of the points whose rate (point_id, rate) is in the
    fullest of `bins` bins, or of 10 where there are under 40 points: the most frequent rate is taken for that of stable
    ground. As in peak_members(), a bin holds its lower edge only."""
    if rates.limit(40).count() < 40:
        bins = 10
    members = peak_members(rates, "rate", bins).select("point_id")
    mean = phases.join(members, "point_id", "left_semi").groupBy("k").agg(F.avg("phase").alias("reference"))
    return phases.join(F.broadcast(mean), "k").select("point_id", "k", (F.col("phase") - F.col("reference")).alias("phase"))  # one row for each epoch


def histogram(fits: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of a value in `bins` equal bins of its range; the last one holds its upper edge. Empty bins have no row."""
    edge = fits.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    return fits.join(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
