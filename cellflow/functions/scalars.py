"""Scalar expressions: units, guards, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RHO_WATER = 1027.0
RHO_ICE = 918.0
SECONDS_PER_YEAR = 86400 * 365.25
MAD_TO_SIGMA = 1.4826
TUKEY_C = 4.685
REFERENCE_HPA = 1013.25
METRES_PER_HPA = 0.01


def nan_to_null(x: Column) -> Column:
    """Missing values are NULL here; NaN is turned into it once, where data comes in."""
    return F.when(~F.isnan(x), x)


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(den > 0, num / den)


def seconds(t: Column) -> Column:
    """Seconds since 1970 of a timestamp (with or without zone, read as UTC)."""
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def years_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6) / F.lit(SECONDS_PER_YEAR)


def decimal_year(t: Column) -> Column:
    """The year and how far into it, by that year's own length."""
    y = F.year(t)
    start, end = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y + 1, F.lit(1), F.lit(1))
    return y + (seconds(t) - F.unix_date(start) * 86400) / (F.datediff(end, start) * 86400)


def thickness(freeboard: Column, firn: Column | float = 0.0) -> Column:
    """Ice thickness of a floating column from its height above water, less the air in its firn."""
    return (freeboard - F.lit(firn) if isinstance(firn, float) else freeboard - firn) * (RHO_WATER / (RHO_WATER - RHO_ICE))


def inverse_barometer(hpa: Column) -> Column:
    """Height correction for air pressure."""
    return (hpa - REFERENCE_HPA) * -METRES_PER_HPA


def half_even(x: Column) -> Column:
    """Rounding as array libraries do it: halves to even."""
    return F.rint(x)


def polar_stereographic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of the WGS84 Antarctic polar stereographic projection, true at 71 degrees south."""
    a, e, std = 6378137.0, 0.0818191908426215, 71.0
    import math

    phi = math.radians(std)
    tc = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    mc = math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)
    p, lam = F.radians(-lat), F.radians(lon)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    rho = a * mc * t / tc
    return rho * F.sin(lam), rho * F.cos(lam)
