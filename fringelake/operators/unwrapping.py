"""Temporal unwrapping of arcs and densification: the velocity and elevation error that leave the most coherent residuals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phase import wrap

#: Rows that are searched together.
ROWS = 256


def unit_vectors(observations: DataFrame, *by: str) -> DataFrame:
    """(by..., k, re, im): mean unit vector of the phases of each epoch. The coherence of several arcs together depends on
    these means only, so arcs are averaged before anything is searched."""
    return observations.groupBy(*by, "k").agg(F.avg(F.cos("phase")).alias("re"), F.avg(F.sin("phase")).alias("im"))


def stacks(vectors: DataFrame, design: DataFrame, *by: str) -> DataFrame:
    """One row for each group with arrays re, im, of_demerr, of_vel in the order of epochs. design (k, of_demerr, of_vel) has
    one row for each epoch, so it is small and so are the arrays."""
    epochs = vectors.join(F.broadcast(design), "k")
    rows = epochs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "re", "im", "of_demerr", "of_vel"))).alias("e"))
    return rows.select(*by, *[F.col(f"e.{x}").alias(x) for x in ("re", "im", "of_demerr", "of_vel")])


def estimate(z: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: tuple[float, float], samples: int, factor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, coherence) of the model a * factor * x + b * y, factor being one of each row, or 1, for each row of unit vectors z (rows, epochs). Both parameters are
    searched together on a grid, whose coherences are matrix products, as searches of one after the other can end at a
    side lobe; the best pairs are refined by bounded Gauss-Newton steps, all rows at once, that never lose coherence."""
    factor = np.ones(len(z)) if factor is None else factor
    widest = factor.max(initial=0) or 1.0
    # the grid is that of the row with the widest range; other rows pass over what is beyond theirs
    grid = [np.linspace(-m, m, samples) for m in (bounds[0] * widest, bounds[1])]
    of_x, of_y = (np.exp(-1j * np.outer(g, d)) for g, d in zip(grid, (a, b)))
    x = np.empty((len(z), 2))
    for at in range(0, len(z), 64):
        gamma = np.abs((of_x * z[at : at + 64, None, :]) @ of_y.T) / z.shape[1]
        gamma[np.abs(grid[0])[None, :] > bounds[0] * factor[at : at + 64, None] * (1 + 1e-9)] = -1
        gamma = gamma.reshape(len(gamma), -1)
        i, j = np.divmod(np.argmax(np.round(gamma, 12), axis=1), samples)
        x[at : at + 64] = np.stack([grid[0][i], grid[1][j]], axis=1)

    def turned(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return z[rows] * np.exp(-1j * (at[:, :1] * a + at[:, 1:] * b))

    limit, columns = np.stack([bounds[0] * factor, np.full(len(z), float(bounds[1]))], axis=1), np.stack([a, b, np.ones_like(a)])
    rows = np.arange(len(z))
    now = turned(rows, x).mean(axis=1)
    for _ in range(30):
        if not len(rows):
            break
        weight = np.abs(z[rows]) ** 2
        residual = np.angle(turned(rows, x[rows]) * np.conj(now[rows])[:, None])
        normal = np.einsum("rk,ik,jk->rij", weight, columns, columns)
        step = (np.linalg.pinv(normal, hermitian=True) @ ((weight * residual) @ columns.T)[:, :, None])[:, :2, 0]
        gain, open_rows = np.zeros(len(rows)), np.arange(len(rows))
        for _ in range(12):
            tried = np.clip(x[rows[open_rows]] + step[open_rows], -limit[rows[open_rows]], limit[rows[open_rows]])
            new = turned(rows[open_rows], tried).mean(axis=1)
            better = np.abs(new) > np.abs(now[rows[open_rows]])
            done = rows[open_rows[better]]
            gain[open_rows[better]] = np.abs(new[better]) - np.abs(now[done])
            x[done], now[done] = tried[better], new[better]
            open_rows = open_rows[~better]
            step[open_rows] /= 2
        rows = rows[gain >= 1e-12]
    return x / np.stack([factor, np.ones(len(z))], axis=1), np.abs(now)


def search(stacked: DataFrame, by: list[str], demerr_bound: float, velocity_bound: float, samples: int = 100) -> DataFrame:
    """(by..., demerr, vel, gamma) for each row of stacks(), in whose model the elevation error counts `factor` times, if there is such
    a column. Rows are independent; of ROWS of them those with the same epochs are
    searched together, so a task's memory does not follow the size of its batches."""
    kinds = {f.name: f.dataType.simpleString() for f in stacked.schema.fields}
    out = ", ".join(f"{x} {kinds[x]}" for x in by) + ", demerr double, vel double, gamma double"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                arrays = {c: rows.column(c) for c in ("re", "im", "of_demerr", "of_vel")}
                ends = arrays["re"].offsets.to_numpy()
                values = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in arrays.items()}
                same: dict[tuple, list[int]] = {}
                for i, (a, z) in enumerate(zip(ends - ends[0], ends[1:] - ends[0])):
                    same.setdefault((values["of_demerr"][a:z].tobytes(), values["of_vel"][a:z].tobytes()), []).append(i)
                factor = rows.column("factor").to_numpy(zero_copy_only=False).astype(float) if "factor" in rows.schema.names else None
                for key, places in same.items():
                    a, b = (np.frombuffer(k) for k in key)
                    epochs = (ends[places] - ends[0])[:, None] + np.arange(len(a))
                    z = values["re"][epochs] + 1j * values["im"][epochs]
                    x, gamma = estimate(z, a, b, (demerr_bound, velocity_bound), samples, None if factor is None else factor[places])
                    kept = rows.select(by).take(pa.array(places))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(gamma)], names=[*by, "demerr", "vel", "gamma"])

    return stacked.mapInArrow(run, out)


def _with_factors(stacked: DataFrame, factors: DataFrame | None, *by: str) -> DataFrame:
    return stacked if factors is None else stacked.join(factors.select(*by, "factor"), list(by))


def unwrap_arcs(observations: DataFrame, design: DataFrame, demerr_bound: float, velocity_bound: float, samples: int = 100, factors: DataFrame | None = None) -> DataFrame:
    """(src, dst, demerr, vel, gamma) of arcs with observations (src, dst, k, phase). factors (src, dst, factor) tell how many times
    the design's column for the elevation error counts at an arc, as places differ in range and incidence; without them once."""
    stacked = _with_factors(stacks(unit_vectors(observations, "src", "dst"), design, "src", "dst"), factors, "src", "dst")
    return search(stacked, ["src", "dst"], demerr_bound, velocity_bound, samples)


def densify(second: DataFrame, first: DataFrame, neighbours: DataFrame, design: DataFrame, demerr_bound: float, velocity_bound: float, samples: int = 100, factors: DataFrame | None = None) -> DataFrame:
    """(point_id, demerr, vel, gamma) of second-order points with phases (point_id, k, phase), from their arcs to the
    first-order neighbours (a, b) whose model has been removed from first (point_id, k, phase). factors (point_id, factor) as in
    unwrap_arcs()."""
    arcs = neighbours.select(F.col("a").alias("point_id"), "b")
    one = first.select(F.col("point_id").alias("b"), "k", F.col("phase").alias("other"))
    seen = arcs.join(second, "point_id").join(one, ["b", "k"]).select("point_id", "k", wrap(F.col("phase") - F.col("other")).alias("phase"))
    stacked = _with_factors(stacks(unit_vectors(seen, "point_id"), design, "point_id"), factors, "point_id")
    return search(stacked, ["point_id"], demerr_bound, velocity_bound, samples)
