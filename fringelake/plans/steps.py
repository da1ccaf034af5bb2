"""The processing steps as functions from tables to tables, joined by one configuration.

Tables: slc (point_id, img, re, im); acquisitions (idx, date, tbase in days, pbase in metres); points (point_id, y, x, inc in radians,
slant_range in metres). Each step returns a named tuple of tables; what several later parts read is written once. The phase of
an interferogram is that of the first image less the second's, as of its model, so parameters have the sign of acquisitions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.phase import circular_coherence, geolocation_shift, wrap
from ..functions.projection import utm
from ..operators import atmosphere as atm
from ..operators import elimination
from ..operators import estimation as est
from ..operators import graph
from ..operators import network as net
from ..operators import pixels as px
from ..operators import unwrapping as unw
from ..operators import variogram as vg
from ..scratch import scratch


class Prepared(NamedTuple):
    acquisitions: DataFrame
    network: DataFrame
    ifgs: DataFrame
    coherence: DataFrame
    amplitude: DataFrame


class Checked(NamedTuple):
    points: DataFrame
    arcs: DataFrame
    phases: DataFrame


class Unwrapped(NamedTuple):
    parameters: DataFrame
    series: DataFrame


class Filtered(NamedTuple):
    points: DataFrame
    atmosphere: DataFrame
    series: DataFrame


class Densified(NamedTuple):
    points: DataFrame
    parameters: DataFrame
    series: DataFrame


def within_dates(acquisitions: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Acquisitions between two ISO dates, both included and numbered anew. No dates keep all; a start after the last
    acquisition, or an end before the first, raises ValueError."""
    if first is None and last is None:
        return acquisitions
    lo, hi = acquisitions.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    if first and first > hi or last and last < lo:
        raise ValueError(f"no acquisition between {first} and {last}: they are from {lo} to {hi}")
    day = F.col("date").cast("string")
    return acquisitions.where((day >= (first or lo)) & (day <= (last or hi)))


def preparation(slc: DataFrame, acquisitions: DataFrame, points: DataFrame, config: Config) -> Prepared:
    """The network of images, interferograms (point_id, first, second, re, im), temporal phase coherence (point_id, gamma) and the
    mean amplitude (point_id, bmap)."""
    p = config.preparation
    acq = within_dates(acquisitions, p.start_date, p.end_date)
    if p.start_date or p.end_date:
        # images keep their numbers; the network goes by their order
        order = acq.select(F.col("idx").alias("img"), (F.expr("row_number() over (order by idx)") - 1).cast("int").alias("n"))
        slc = slc.join(F.broadcast(order), "img").drop("img").withColumnRenamed("n", "img")
        acq = acq.withColumnRenamed("idx", "img").join(F.broadcast(order), "img").drop("img").withColumnRenamed("n", "idx")
    acq = scratch(acq, "acquisitions")
    network = scratch(net.with_baselines(net.of_type(p.ifg_network_type, acq, p.num_ifgs, p.max_tbase), acq), "network")
    ifgs = scratch(px.interferograms(slc, network), "ifgs")
    height, width = points.agg(F.max("y") + 1, F.max("x") + 1).first()
    gamma = px.temporal_coherence(ifgs, points, p.filter_window_size // 2, int(height), int(width))
    coherence = scratch(gamma.join(points.select("point_id", "y", "x"), ["y", "x"]).select("point_id", "gamma"), "coherence")
    return Prepared(acq, network, ifgs, coherence, px.mean_amplitude(slc))


def _selected(prepared: Prepared, points: DataFrame, limit: float, cell: int, mask: DataFrame | None) -> DataFrame:
    """Coherent points: the best of each cell first, then valid ones and those of the mask (point_id), if one is given."""
    rows = points.join(prepared.coherence, "point_id")
    if cell:
        rows = px.best_in_cell(rows, "gamma", cell).drop("cy", "cx")
    rows = px.at_least(rows, "gamma", limit).join(px.valid(prepared.amplitude, "bmap").select("point_id"), "point_id", "left_semi")
    return rows if mask is None else rows.join(mask.select("point_id"), "point_id", "left_semi")


def _phases(prepared: Prepared, points: DataFrame) -> DataFrame:
    """(point_id, first, second, k, phase): k numbers the interferograms."""
    numbers = prepared.network.select("first", "second", (F.expr("row_number() over (order by first, second)") - 1).cast("int").alias("k"))
    some = prepared.ifgs.join(points.select("point_id"), "point_id", "left_semi")
    return some.join(F.broadcast(numbers), ["first", "second"]).select("point_id", "k", F.atan2("im", "re").alias("phase"))


def design(prepared: Prepared, wavelength: float) -> DataFrame:
    """(k, of_demerr, of_vel): phase of an interferogram for a metre of elevation error, times slant range and sine of incidence, and
    for a metre a year; first image less second."""
    n = prepared.network.withColumn("k", (F.expr("row_number() over (order by first, second)") - 1).cast("int"))
    scale = 4 * math.pi / wavelength
    return n.select("k", (-scale * F.col("pbase_ifg")).alias("of_demerr"), (-scale * F.col("tbase_ifg")).alias("of_vel"))


def factors(points: DataFrame) -> DataFrame:
    """(point_id, factor): what the design's elevation error counts at each point, by its slant range and incidence."""
    return points.select("point_id", (1 / (F.col("slant_range") * F.sin("inc"))).alias("factor"))


def arc_factors(points: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, dst, factor) of arcs, by the means of their ends' slant ranges and incidences."""
    one, two = (points.select(F.col("point_id").alias(e), F.col("slant_range").alias(f"r_{e}"), F.col("inc").alias(f"i_{e}")) for e in ("src", "dst"))
    both = arcs.select("src", "dst").join(one, "src").join(two, "dst")
    return both.select("src", "dst", (4 / ((F.col("r_src") + F.col("r_dst")) * F.sin((F.col("i_src") + F.col("i_dst")) / 2)) / 2).alias("factor"))


def consistency_check(prepared: Prepared, points: DataFrame, config: Config, wavelength: float, mask: DataFrame | None = None) -> Checked:
    """Points of first order and their arcs (src, dst, demerr, vel, gamma): coherent points, without those whose arcs do not agree;
    arcs built and unwrapped again between the rest, without bad ones that the network can do without."""
    c = config.consistency_check
    chosen = scratch(_selected(prepared, points, c.coherence_p1, c.grid_size, mask), "chosen")
    phases, model = scratch(_phases(prepared, chosen), "phases"), scratch(design(prepared, wavelength), "design")
    longest, bounds = c.max_arc_length or float("inf"), (c.dem_error_bound, c.velocity_bound, c.num_optimization_samples)

    def unwrapped(p: DataFrame) -> DataFrame:
        arcs = graph.build_arcs(p.select("point_id", "y", "x"), c.num_nearest_neighbours, longest, 2.0)
        return scratch(unw.unwrap_arcs(px.arc_observations(phases, arcs.select("src", "dst")), model, *bounds, arc_factors(points, arcs)), "arcs")

    good = graph.without_bad_points(unwrapped(chosen), c.point_median_coherence)
    ends = good.select(F.col("src").alias("point_id")).unionByName(good.select(F.col("dst").alias("point_id"))).distinct()
    kept = scratch(chosen.join(ends, "point_id", "left_semi"), "kept")
    arcs = scratch(graph.without_bad_arcs(unwrapped(kept), c.arc_unwrapping_coherence), "arcs")
    return Checked(kept, arcs, phases.join(kept.select("point_id"), "point_id", "left_semi"))


def _inverted(prepared: Prepared, phases: DataFrame) -> DataFrame:
    """(point_id, k, phase): the series of images from interferograms (point_id, k, phase); the weights are images times
    interferograms."""
    pairs = [(r["first"], r["second"]) for r in prepared.network.select("first", "second").orderBy("first", "second").collect()]  # few
    return est.invert(phases.withColumnRenamed("k", "ifg"), pairs, prepared.acquisitions.count()).withColumnRenamed("img", "k")


def _restored(prepared: Prepared, points: DataFrame, phases: DataFrame, parameters: DataFrame, arcs: DataFrame, wavelength: float) -> DataFrame:
    """Series referenced to the peak of the velocities: the model is taken off, the wrapped rest is unwrapped in space along arcs (src,
    dst), and the model is put back before the inversion."""
    both = phases.join(parameters.select("point_id", "demerr", "vel"), "point_id").join(factors(points), "point_id").join(F.broadcast(design(prepared, wavelength)), "k")
    model = F.col("of_demerr") * F.col("factor") * F.col("demerr") + F.col("of_vel") * F.col("vel")
    both = scratch(both.select("point_id", "k", model.alias("model"), wrap(F.col("phase") - model).alias("phase")), "rest")
    reference = parameters.agg(F.min("point_id")).first()[0]
    rest = elimination.unwrap(both.select("point_id", "k", "phase"), arcs, points.select("point_id", "y", "x"), reference)
    whole = both.select("point_id", "k", "model").join(rest, ["point_id", "k"]).select("point_id", "k", (F.col("phase") + F.col("model")).alias("phase"))
    return est.to_histogram_peak(scratch(_inverted(prepared, whole), "series"), parameters.select("point_id", F.col("vel").alias("rate")))


def unwrapping(prepared: Prepared, checked: Checked, points: DataFrame, wavelength: float, config: Config | None = None) -> Unwrapped:
    """Parameters (point_id, demerr, vel) and series (point_id, k, phase) of the points of first order. The parameters of arcs are
    integrated to points from the smallest id on; a network that does not hang together raises NotConnected."""
    reference = checked.points.agg(F.min("point_id")).first()[0]
    arcs = checked.arcs.withColumn("weight", F.col("gamma"))
    parameters = elimination.integrate(arcs, checked.points.select("point_id", "y", "x"), reference, ["demerr", "vel"])
    if config is None or config.unwrapping.use_arcs_from_temporal_unwrapping:
        links = checked.arcs
    else:
        links = graph.build_arcs(checked.points.select("point_id", "y", "x"), 8, float("inf"), 2.0)
    return Unwrapped(parameters, _restored(prepared, points, checked.phases, parameters, links, wavelength))


def _residuals(prepared: Prepared, points: DataFrame, series: DataFrame, wavelength: float) -> DataFrame:
    """(point_id, k, t, phase): the series less its elevation error, velocity and constant, estimated for each point."""
    acq = prepared.acquisitions.select(F.col("idx").alias("k"), (F.col("tbase") / 365.25).alias("years"), "pbase")
    scale = 4 * math.pi / wavelength
    rows = series.join(F.broadcast(acq), "k").join(points.select("point_id", "slant_range", "inc"), "point_id")
    rows = rows.select("point_id", "k", (scale * F.col("pbase") / (F.col("slant_range") * F.sin("inc"))).alias("p"), (scale * F.col("years")).alias("t"), F.col("phase").alias("value"))
    fits = est.velocity_and_elevation(rows)
    return rows.join(fits, "point_id").select("point_id", "k", "t", F.expr("value - demerr * p - vel * t - atmosphere").alias("phase"))


def second_order_points(prepared: Prepared, checked: Checked, points: DataFrame, config: Config, linked: DataFrame | None = None, linked_mask: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """The rows of points that are of second order: coherent ones; those that phase linking found, if its results `linked` (point_id,
    coherence, siblings and, where single scatterers count, persistent) are given and the configuration asks for them, within
    linked_mask (point_id); and all of first order. Of these the valid ones within mask (point_id) stay, so points of first order
    go too where a mask leaves them out."""
    f, p = config.filtering, config.phase_linking
    found = px.at_least(prepared.coherence, "gamma", f.coherence_p2).select("point_id")
    if p.use_phase_linking_results:
        if linked is None:
            raise ValueError("the configuration asks for results of phase linking, but there are none")
        more = px.second_order(linked, "coherence", f.coherence_p2, "siblings", p.num_siblings, "persistent" if p.use_ps else None).select("point_id")
        found = found.unionByName(more if linked_mask is None else more.join(linked_mask.select("point_id"), "point_id", "left_semi"))
    found = found.unionByName(checked.points.select("point_id"))
    found = found.join(px.valid(prepared.amplitude, "bmap").select("point_id"), "point_id", "left_semi")
    if mask is not None:
        found = found.join(mask.select("point_id"), "point_id", "left_semi")
    return points.join(found, "point_id", "left_semi")


def filtering(prepared: Prepared, checked: Checked, unwrapped: Unwrapped, points: DataFrame, config: Config, wavelength: float, neighbours: int = 20, linked: DataFrame | None = None, linked_mask: DataFrame | None = None, mask: DataFrame | None = None) -> Filtered:
    """Points of second order, the atmosphere (point_id, k, phase) at the points of both orders, and the series of first order
    without it. The atmosphere comes from the points of first order whose residuals are least correlated in time."""
    f = config.filtering
    every = scratch(second_order_points(prepared, checked, points, config, linked, linked_mask, mask), "second")
    rest = scratch(_residuals(prepared, points, unwrapped.series, wavelength), "residuals")
    if not f.apply_aps_filtering:
        none = every.select("point_id").join(F.broadcast(prepared.acquisitions.select(F.col("idx").alias("k")))).withColumn("phase", F.lit(0.0))
        return Filtered(every, none, unwrapped.series)
    calm = est.autocorrelation(rest, "phase", ["k"]).where(F.col("autocorrelation") <= f.max_temporal_autocorrelation)
    stable = px.best_in_cell(checked.points.drop("gamma").join(calm, "point_id"), "autocorrelation", f.grid_size, largest=False)
    stable = scratch(stable.select("point_id", "y", "x"), "stable")
    calm_rest = scratch(rest.join(stable.select("point_id"), "point_id", "left_semi").select("point_id", "k", "phase"), "calm")
    near = px.nearest(every, stable, neighbours, float(f.grid_size))
    if f.interpolation_method == "kriging":
        # pairs of stable points up to some cells apart, or a third of their extent, tell how the atmosphere varies
        reach = min(vg.reach_of(stable), 15.0 * f.grid_size)
        field = atm.krige_fitted(near, stable, calm_rest, vg.fitted(vg.empirical(stable, calm_rest, reach)))
    elif f.interpolation_method == "linear":
        field = atm.linear(every, stable, calm_rest, float(f.grid_size))
    else:
        field = atm.by_distance(near, calm_rest)
    field = scratch(field, "atmosphere")
    series = unwrapped.series.join(field.withColumnRenamed("phase", "aps"), ["point_id", "k"]).select("point_id", "k", (F.col("phase") - F.col("aps")).alias("phase"))
    return Filtered(every, field, series)


def densification(prepared: Prepared, checked: Checked, unwrapped: Unwrapped, filtered: Filtered, points: DataFrame, config: Config, wavelength: float) -> Densified:
    """Parameters (point_id, demerr, vel, gamma) and series of the points of both orders: those of second order are unwrapped
    against their nearest points of first order, whose model is known, and kept if they are coherent."""
    d = config.densification
    back = net.to_interferograms(filtered.atmosphere.withColumnRenamed("k", "img"), prepared.network)
    numbers = prepared.network.select("first", "second", (F.expr("row_number() over (order by first, second)") - 1).cast("int").alias("k"))
    aps = back.join(F.broadcast(numbers), ["first", "second"]).select("point_id", "k", F.col("phase").alias("aps"))
    phases = _phases(prepared, filtered.points).join(aps, ["point_id", "k"]).select("point_id", "k", wrap(F.col("phase") - F.col("aps")).alias("phase"))
    phases, model = scratch(phases, "phases"), scratch(design(prepared, wavelength), "design")
    one = unwrapped.parameters
    flat = phases.join(one, "point_id").join(factors(points), "point_id").join(F.broadcast(model), "k").select("point_id", "k", (F.col("phase") - F.col("of_demerr") * F.col("factor") * F.col("demerr") - F.col("of_vel") * F.col("vel")).alias("phase"))
    rest = filtered.points.join(one.select("point_id"), "point_id", "left_anti")
    # the three nearest always count, others within the limit only
    near = px.nearest(rest, checked.points, d.num_connections_to_p1, 2.0).where((F.col("rank") <= 3) | (F.col("d2") < d.max_distance_to_p1**2) & (F.col("d2") != 0))
    two = unw.densify(phases, flat, near, model, d.dem_error_bound, d.velocity_bound, d.num_optimization_samples, factors(points)).where(F.col("gamma") >= d.arc_unwrapping_coherence)
    parameters = scratch(one.withColumn("gamma", F.lit(1.0)).unionByName(two), "parameters")
    kept = filtered.points.join(parameters.select("point_id"), "point_id", "left_semi")
    arcs = graph.build_arcs(kept.select("point_id", "y", "x"), d.num_connections_to_p1 + 3, float("inf"), 2.0)
    return Densified(kept, parameters, _restored(prepared, points, phases, parameters, arcs, wavelength))


def exported(prepared: Prepared, densified: Densified, points: DataFrame, wavelength: float, heading: float | None = None) -> DataFrame:
    """(point_id, y, x, velocity and st_consist in millimetres, coherence, omega, dem_error and a column D<date> in millimetres for each
    image). Points with lat and lon get easting and northing too, and a height `dem` if they have one; with a heading in radians
    their places are corrected for the elevation error. st_consist is null where no point lies in the ring around a point."""
    acq = prepared.acquisitions.select(F.col("idx").alias("k"), (F.col("tbase") / 365.25).alias("years"), "pbase", F.date_format("date", "'D'yyyyMMdd").alias("epoch"))
    scale = 4 * math.pi / wavelength
    rows = densified.series.join(F.broadcast(acq), "k").join(points.select("point_id", "slant_range", "inc"), "point_id")
    rows = rows.withColumn("p", scale * F.col("pbase") / (F.col("slant_range") * F.sin("inc"))).withColumn("t", scale * F.col("years"))
    fits = est.velocity_and_elevation(rows.select("point_id", "p", "t", F.col("phase").alias("value")))
    both = rows.join(fits, "point_id")
    off = F.expr("phase - demerr * p - vel * t - atmosphere")
    quality = both.groupBy("point_id").agg(circular_coherence(off).alias("coherence"), F.sum(off * off).alias("omega"))
    names = [r.epoch for r in acq.select("epoch").orderBy("epoch").collect()]  # one for each image
    wide = px.wide(both.select("point_id", "epoch", (1000 * (F.col("phase") - F.col("p") * F.col("demerr")) / scale).alias("mm")), "mm", names)
    located = {"lat", "lon"} <= set(points.columns)
    place = points.select("point_id", "y", "x", *([utm("lat", "lon")[1].alias("easting"), utm("lat", "lon")[2].alias("northing"), "inc"] if located else []), *([F.col("height").alias("dem")] if "height" in points.columns else []))
    metric = place.join(densified.points.select("point_id"), "point_id", "left_semi").select("point_id", F.col("northing" if located else "y").alias("y"), F.col("easting" if located else "x").alias("x"))
    near = {} if located else {"least": 1.0, "radius": 3.0}  # without places in metres, pixels
    agree = px.spatiotemporal_consistency(densified.series, metric, wavelength, **near).select("point_id", (1000 * F.col("consistency")).alias("st_consist"))
    out = place.join(fits.select("point_id", (1000 * F.col("vel")).alias("velocity"), F.col("demerr").alias("dem_error")), "point_id")
    if located and heading is not None:
        east, north = geolocation_shift(F.col("dem_error"), F.lit(float(heading)), F.col("inc"))
        out = out.withColumn("easting", F.col("easting") + east).withColumn("northing", F.col("northing") + north)
    return out.drop("inc").join(quality, "point_id").join(agree, "point_id", "left").join(wide, "point_id")


def as_features(rows: DataFrame) -> DataFrame:
    """The rows of exported() as points for a vector file: (kind, geometry, properties), of which names have ten characters, as the
    narrowest format has."""
    x, y = ("easting", "northing") if "easting" in rows.columns else ("x", "y")
    place = F.array(F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    order = ["point_id", "velocity", "coherence", "omega", "st_consist", "dem_error", "dem"]
    named = [c for c in order if c in rows.columns] + [c for c in rows.columns if c not in {*order, "easting", "northing", "y", "x"}]
    pairs = F.array(*[F.struct(F.lit(c[:10]).alias("key"), F.col(c).cast("string").alias("value")) for c in named])
    return rows.select(F.lit("Point").alias("kind"), place.alias("geometry"), F.map_from_entries(pairs).alias("properties"))
