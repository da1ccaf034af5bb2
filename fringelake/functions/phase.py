"""Phase arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def wrap(x: Column) -> Column:
    """An angle brought to (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def circular_coherence(angle: Column) -> Column:
    """Aggregate: length of the mean unit vector of angles."""
    return F.sqrt(F.pow(F.avg(F.cos(angle)), 2) + F.pow(F.avg(F.sin(angle)), 2))


def model_phase(velocity: Column, dem_error: Column, tbase: Column, pbase: Column, slant_range: Column, incidence: Column, wavelength: float) -> Column:
    """Phase of a velocity (m/yr) and an elevation error (m); baselines in years and metres, incidence in radians."""
    scale = 4 * math.pi / wavelength
    return scale * tbase * velocity + scale * pbase / (slant_range * F.sin(incidence)) * dem_error


def displacement_mm(phase: Column, dem_error: Column, pbase: Column, slant_range: Column, incidence: Column, wavelength: float) -> Column:
    """Line-of-sight displacement without the elevation error's part."""
    return 1000 * (phase * wavelength / (4 * math.pi) - pbase / (slant_range * F.sin(incidence)) * dem_error)


#: Units of length and how many of them a metre has.
PER_METRE = {"mm": 1000, "cm": 100, "dm": 10, "m": 1}


def in_unit(metres: Column, unit: str) -> Column:
    """A length, or a rate of one, in another unit; ValueError for a unit that is not known. Null stays null."""
    if unit not in PER_METRE:
        raise ValueError(f"unit {unit!r} is none of {', '.join(PER_METRE)}")
    return metres * PER_METRE[unit]


def images_between(rows: DataFrame, first: int, last: int, image: str = "k") -> DataFrame:
    """Rows of the images from first up to last, the end excluded; negative numbers count from the last image, as in slices of
    arrays. A plain filter, which reaches the scan, unless a number is negative. No such image: no rows."""
    at = F.col(image)
    if first < 0 or last < 0:
        n = rows.agg(F.coalesce(F.max(image) + 1, F.lit(0)).alias("n")).first().n
        first, last = (max(0, x + n) if x < 0 else x for x in (first, last))
    return rows.where((at >= first) & (at < last))


def geolocation_shift(dem_error: Column, heading: Column, incidence: Column) -> tuple[Column, Column]:
    """(east, north) shift in metres of a point with an elevation error."""
    ground = dem_error / F.tan(incidence)
    return ground * F.cos(heading), -ground * F.sin(heading)


def years(days: Column) -> Column:
    return days / DAYS_PER_YEAR
