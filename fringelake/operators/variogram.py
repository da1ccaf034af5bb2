"""Variograms of all epochs at once, and the models that fit them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elimination import in_arrays
from .pixels import within

#: Bins of distance, and the least number that a fit needs.
BINS, LEAST = 30, 4
_LENGTHS, _POWERS = np.geomspace(0.02, 3.0, 28), np.linspace(0.2, 2.0, 19)
#: Bounds of the exponent, as the model is one of a random field for these only.
_LOW, _HIGH = 0.05, 2.0
MODEL = "k int, variance double, length double, power double, nugget double"


def reach_of(points: DataFrame, share: float = 1 / 3) -> float:
    """The greatest distance of a variogram: a share of the diagonal of the box around the points (point_id, y, x)."""
    y0, y1, x0, x1 = points.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    return 0.0 if y0 is None else float(np.hypot(y1 - y0, x1 - x0)) * share


def empirical(points: DataFrame, residuals: DataFrame, reach: float, bins: int = BINS) -> DataFrame:
    """(k, bin, n, distance, semivariance): half the mean square difference of the residuals (point_id, k, phase) of pairs of points
    (point_id, y, x) nearer than `reach`, by epoch and bin of equal width; distance is the bin's centre. Points have all epochs.

    Pairs come from an equi-join on squares; each pair is one row with the arrays of both ends, and a task sums up its pairs of
    all epochs before anything is shuffled. Their number grows with the square of the reach, so that should be a few spacings
    of the points where they are many."""
    if not reach > 0:
        return residuals.sparkSession.createDataFrame([], "k int, bin int, n long, distance double, semivariance double")
    values = in_arrays(residuals, 1 << 30).select("point_id", F.col("psi").alias("v"))
    pairs = within(points, points, reach).where(f"a < b and d2 < {reach * reach!r}")
    one, two = (values.select(F.col("point_id").alias(e), F.col("v").alias(f"v{e}")) for e in ("a", "b"))
    rows = pairs.join(one, "a").join(two, "b").select(F.least(F.floor(F.sqrt("d2") / reach * bins), F.lit(bins - 1)).cast("int").alias("bin"), "va", "vb")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(bins, np.int64), None
        for b in batches:
            if not len(b):
                continue
            square = (np.stack(b["va"].to_numpy()) - np.stack(b["vb"].to_numpy())) ** 2
            total = np.zeros((bins, square.shape[1])) if total is None else total
            np.add.at(total, b["bin"].to_numpy(), square)
            n += np.bincount(b["bin"].to_numpy(), minlength=bins)
        if total is not None:
            some = np.flatnonzero(n)
            yield pd.DataFrame({"bin": some, "n": n[some], "total": list(total[some])})

    sums = rows.mapInPandas(summed, "bin int, n long, total array<double>").select("bin", "n", F.posexplode("total").alias("k", "total"))
    out = sums.groupBy("k", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.select("k", "bin", "n", ((F.col("bin") + 0.5) * reach / bins).alias("distance"), (F.col("total") / F.col("n") / 2).alias("semivariance"))


def stable(h: np.ndarray, variance, length, power, nugget) -> np.ndarray:
    """The stable model's semivariance at distances h > 0."""
    return nugget + variance * (1 - np.exp(-((h / length) ** power)))


def fit_all(h: np.ndarray, gamma: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(variance, length, power, nugget) of each row of semivariances gamma (rows, bins) at distances h that fits best in weighted
    least squares; bins of weight 0 do not count. NaN where less than LEAST bins count or nothing varies.

    For a length and a power the model is linear in variance and nugget, neither of which is below zero; so a grid of both is
    searched in closed form, all rows at once, and damped Gauss-Newton steps within the bounds start from each row's best."""
    top = h.max(initial=0.0)
    count = (weight > 0).sum(axis=1)
    good = (count >= LEAST) & (np.where(weight > 0, gamma, 0).max(axis=1, initial=0) > 0)
    out = np.full((len(gamma), 4), np.nan)
    rows = np.flatnonzero(good)
    if not len(rows):
        return out
    g, w = np.where(weight[rows] > 0, gamma[rows], 0), weight[rows]
    w = w / w.sum(axis=1, keepdims=True)
    best, p = np.full(len(rows), np.inf), np.zeros((len(rows), 4))
    s0, s1 = w.sum(axis=1), (w * g).sum(axis=1)
    for length in _LENGTHS * top:
        for power in _POWERS:
            f = 1 - np.exp(-((h / length) ** power))
            sf, sff, sfg = w @ f, w @ (f * f), (w * g) @ f
            det = s0 * sff - sf * sf
            with np.errstate(all="ignore"):
                slope, level = (s0 * sfg - sf * s1) / det, (sff * s1 - sf * sfg) / det
                alone = sfg / sff
            bad = ~np.isfinite(slope) | (slope < 0) | (level < 0)
            # on the bounds: the model without nugget, or without what varies
            options = [(np.where(bad, 0, slope), np.where(bad, np.inf, level)), (np.maximum(alone, 0), np.zeros(len(rows))), (np.zeros(len(rows)), s1 / s0)]
            for variance, nugget in options:
                fine = np.isfinite(nugget) & np.isfinite(variance)
                off = np.where(fine, (w * (np.where(fine, nugget, 0)[:, None] + np.where(fine, variance, 0)[:, None] * f - g) ** 2).sum(axis=1), np.inf)
                take = off < best
                best[take] = off[take]
                p[take] = np.stack([variance, np.full(len(rows), length), np.full(len(rows), power), nugget], axis=1)[take]
    low, high = np.array([0, 1e-3 * top, _LOW, 0]), np.array([np.inf, 10 * top, _HIGH, np.inf])
    damp = np.full(len(rows), 1e-3)
    for _ in range(200):
        v, l, a, n = (p[:, i : i + 1] for i in range(4))
        q = (h / l) ** a
        e = np.exp(-q)
        off = n + v * (1 - e) - g
        jac = np.stack([1 - e, -v * e * q * a / l, v * e * q * np.log(h / l), np.ones_like(e)], axis=2)
        # parameters on a bound that would leave it stay there
        grad = np.einsum("rb,rb,rbi->ri", w, off, jac)
        held = (p <= low) & (grad > 0) | (p >= high) & (grad < 0)
        jac = np.where(held[:, None, :], 0, jac)
        normal = np.einsum("rb,rbi,rbj->rij", w, jac, jac)
        scale = np.einsum("rii->ri", normal)
        system = normal + np.einsum("r,ri,ij->rij", damp, scale, np.eye(4)) + np.eye(4) * np.where(held, 1, 1e-300)[:, :, None]
        step = -np.linalg.solve(system + 1e-18 * np.eye(4), np.where(held, 0, grad)[:, :, None])[:, :, 0]
        tried = np.clip(p + step, low, high)
        new = (w * (stable(h, *(tried[:, i : i + 1] for i in range(4))) - g) ** 2).sum(axis=1)
        better = new < best
        p[better] = tried[better]
        gain = np.where(better, best - new, 0)
        best = np.where(better, new, best)
        damp = np.where(better, damp / 3, damp * 4)
        if ((damp > 1e12) | better & (gain <= 1e-14 * np.maximum(best, 1e-300))).all():
            break
    out[rows] = p
    return out


def fitted(vario: DataFrame, weighted: bool = False) -> DataFrame:
    """(k, variance, length, power, nugget) of the stable model that fits the variogram (k, bin, n, distance, semivariance) of each
    epoch best, each bin counting once, or by its pairs if `weighted`. An epoch that has too few bins, or does not vary, has no
    row. An epoch is one row of some thirty numbers, and a batch of epochs is fitted at once."""
    rows = vario.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("distance", "semivariance", "n"))).alias("e")).select("k", *[F.col(f"e.{c}").alias(c) for c in ("distance", "semivariance", "n")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.unique(np.concatenate([*b["distance"], []]))
            gamma, weight = np.zeros((len(b), len(h))), np.zeros((len(b), len(h)))
            for i, (d, s, n) in enumerate(zip(b["distance"], b["semivariance"], b["n"])):
                at = np.searchsorted(h, d)
                gamma[i, at], weight[i, at] = s, n if weighted else 1
            p = fit_all(h, gamma, weight)
            fine = np.isfinite(p[:, 0])
            yield pd.DataFrame({"k": b["k"].to_numpy()[fine], **{c: p[fine, i] for i, c in enumerate(("variance", "length", "power", "nugget"))}})

    return rows.mapInPandas(run, MODEL)
