"""Map projection as SQL expressions, which Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, the scale at the central meridian and the false easting of UTM.
AXIS, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm_sql(lat: str, lon: str, zone: str | None = None) -> tuple[str, str, str]:
    """(zone, easting, northing) of degrees as SQL: Krueger's series to the third power of the third flattening, which is exact
    to a millimetre within a zone. South of the equator northing is negative."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    number = zone or f"(floor(({lon} + 180) / 6) + 1)"
    off = f"radians({lon} - ({number} * 6 - 183))"
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos({off}))", f"atanh(sin({off}) / sqrt(1 + ({t}) * ({t})))"
    east = " + ".join([eta] + [f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)])
    north = " + ".join([xi] + [f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)])
    return f"cast({number} as int)", f"({FALSE_EASTING} + {SCALE * radius!r} * ({east}))", f"({SCALE * radius!r} * ({north}))"


def utm(lat: str, lon: str, zone: int | None = None) -> tuple[Column, Column, Column]:
    """(zone, easting, northing) columns of columns in degrees. All points of an image share a zone if it is given."""
    return tuple(F.expr(x) for x in utm_sql(lat, lon, None if zone is None else str(zone)))
