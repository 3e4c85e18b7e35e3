"""Corrections of heights and places as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import RHO_ICE, RHO_WATER

# Speed of light, the WGS84 ellipsoid and the latitude of true scale.
LIGHT = 299_792_458.0
AXIS, ECCENTRICITY, TRUE_SCALE = 6378137.0, 0.0818191908426215, 71.0


def remove_tilt(z: Column, x: Column, y: Column, dx: Column, dy: Column, dz: Column, x0: float = 0.0, y0: float = 0.0) -> Column:
    """z less the plane dx, dy, dz about (x0, y0)."""
    return z - (dx * (x - x0) + dy * (y - y0) + dz)


def freeboard(thickness: Column, firn: float = 0.0) -> Column:
    """Height above water of a floating column of ice, with the air in its firn."""
    return thickness * ((RHO_WATER - RHO_ICE) / RHO_WATER) + firn


def ice_equivalent(kg_m2: Column) -> Column:
    return kg_m2 / RHO_ICE


def wrap180(lon: Column) -> Column:
    """A longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def over_water(z: Column, surface: Column, mask: Column, grounded: int = 2) -> Column:
    """z less a surface that only counts off the ground; null where the surface is unknown there."""
    return z - F.when(mask == grounded, 0.0).otherwise(surface)


def range_from_gate(delay: Column, gate: Column, correction: Column, bin_m: float, centre: float, offset: float = 0.0) -> Column:
    """One-way range of a retracked gate from the window's delay."""
    return F.lit(LIGHT / 2) * delay + (gate - centre) * bin_m + correction + offset


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of Antarctic polar stereographic places: the latitude by the series in the conformal latitude."""
    e, std = ECCENTRICITY, math.radians(TRUE_SCALE)
    tc = math.tan(math.pi / 4 - std / 2) / ((1 - e * math.sin(std)) / (1 + e * math.sin(std))) ** (e / 2)
    mc = math.cos(std) / math.sqrt(1 - (e * math.sin(std)) ** 2)
    chi = math.pi / 2 - 2 * F.atan(F.hypot(x, y) * (tc / (AXIS * mc)))
    e2 = e * e
    # The series' coefficients.
    a = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
    b = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
    c = 7 * e2**3 / 120 + 81 * e2**4 / 1120
    return F.degrees(F.atan2(x, y)), -F.degrees(chi + a * F.sin(2 * chi) + b * F.sin(4 * chi) + c * F.sin(6 * chi))
