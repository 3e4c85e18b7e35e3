"""The linear response of a floating viscous plate to melt at its base, per wavenumber, as column arithmetic (closed forms of the published theory)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wavenumbers(spark: SparkSession, ny: int, nx: int, step: float) -> DataFrame:
    """iy, ix, ky, kx (radians a metre) of a discrete Fourier transform's grid."""
    i = F.col("id")
    rows = spark.range(ny * nx).select(F.floor(i / nx).cast("int").alias("iy"), (i % nx).cast("int").alias("ix"))
    freq = lambda c, n: F.when(F.col(c) < (n + 1) // 2, F.col(c)).otherwise(F.col(c) - n) * (2 * math.pi / (n * step))
    return rows.select("*", freq("iy", ny).alias("ky"), freq("ix", nx).alias("kx"))


def relaxation(kh: Column) -> tuple[Column, Column]:
    """Relaxation R and buoyancy B at dimensionless wavenumbers above 0, in decaying exponentials, which cannot overflow."""
    e1, e2 = F.exp(-kh), F.exp(-2 * kh)
    below = kh * (1 - 2 * (1 + 2 * kh * kh) * e2 + e2 * e2)
    return (1 + 4 * kh * e2 - e2 * e2) / below, 2 * e1 * ((kh + 1) + (kh - 1) * e2) / below


def steady_state(waves: DataFrame, thickness: float, delta: float, along: float = 0.0, across: float = 0.0, stretch: float = 0.0, floor: float = 0.0) -> DataFrame:
    """waves with r, b, mu, growth (the real part of the slower eigenvalue), and the steady response of surface and base, as real and
    imaginary parts h_re, h_im, s_re, s_im.

    along, across: dimensionless advection; stretch: dimensionless extension; floor: the long-wavelength regularisation. At wavenumber 0
    r, b and mu are 0 and the responses are the long-wavelength limits. Between 0 and about 0.01 plate thicknesses per radian rounding
    swamps the closed forms, as r and b nearly cancel. A wave has a steady state only where growth < 0.
    """
    kh = F.sqrt(F.col("kx") ** 2 + F.col("ky") ** 2) * thickness
    some = waves.withColumn("_kh", F.when(kh > 0, kh))
    r, b = (F.coalesce(1 / (floor + 1 / x), F.lit(0.0)) for x in relaxation(F.col("_kh")))
    some = some.select("*", r.alias("r"), b.alias("b"), ((F.col("kx") * along + F.col("ky") * across) * thickness).alias("_a"))
    r, b, a = F.col("r"), F.col("b"), F.col("_a")
    some = some.select("*", F.sqrt(4 * delta * b * b + r * r * (delta - 1) ** 2).alias("mu"),
                       (delta * (r * r - b * b) - stretch * (delta + 1) * r + stretch**2 - a * a).alias("_re"), (a * (delta + 1) * r - 2 * stretch * a).alias("_im"))
    limit = stretch - delta / (2 * (delta + 1))
    re, im = F.col("_re"), F.col("_im")
    size = F.nullif(re * re + im * im, F.lit(0.0))
    at = lambda value, zero: F.when(F.col("_kh").isNull(), F.lit(zero)).otherwise(value)
    dc = (delta / (delta + 1) / limit, -1 / (delta + 1) / limit) if limit else (None, None)
    out = some.select(
        "*",
        at(stretch - r * (1 + delta) / 2 + F.col("mu") / 2, limit).alias("growth"),
        at(-delta * b * re / size, dc[0]).alias("h_re"),
        at(delta * b * im / size, 0.0).alias("h_im"),
        at(((r - stretch) * re + a * im) / size, dc[1]).alias("s_re"),
        at((a * re - (r - stretch) * im) / size, 0.0).alias("s_im"),
    )
    return out.drop("_kh", "_a", "_re", "_im")


def flotation_transfer(response: DataFrame, delta: float) -> DataFrame:
    """response (of steady_state) with t_re, t_im: what a thickness inferred from the surface by flotation shows of the true one, surface over
    the floating share of surface less base; 1 at wavenumber 0, null where surface and base move alike."""
    share = delta / (1 + delta)
    dr, di = (F.col("h_re") - F.col("s_re")) * share, (F.col("h_im") - F.col("s_im")) * share
    size = F.nullif(dr * dr + di * di, F.lit(0.0))
    flat = (F.col("kx") == 0) & (F.col("ky") == 0)
    re, im = (F.col("h_re") * dr + F.col("h_im") * di) / size, (F.col("h_im") * dr - F.col("h_re") * di) / size
    return response.withColumns({"t_re": F.when(flat, 1.0).otherwise(re), "t_im": F.when(flat, 0.0).otherwise(im)})


def secant_viscosity(exx: Column, eyy: Column, exy: Column, softness: float, n: float = 3.0, least: float = 1e-12) -> Column:
    """Viscosity of power-law ice in plane stress at the given strain rates."""
    rate2 = F.greatest(exx * exx + eyy * eyy + exx * eyy + exy * exy, F.lit(least * least))
    return 0.5 * softness ** (-1 / n) * F.pow(rate2, F.lit((1 - n) / (2 * n)))


def steady_multiplier(thickness: float, delta: float, along: float = 0.0, across: float = 0.0, stretch: float = 0.0, part: str = "surface"):
    """steady_state's response of the surface or the base as a function of wavenumbers (numpy, complex), for spectral.apply_multiplier; with
    spectral.damped_inverse it turns a surface back into the melt behind it."""
    import numpy as np

    if part not in ("surface", "base"):
        raise ValueError("part: surface or base")

    def multiplier(ky: np.ndarray, kx: np.ndarray) -> np.ndarray:
        kh = np.hypot(ky, kx) * thickness
        x = np.where(kh > 0, kh, 1.0)
        e1, e2 = np.exp(-x), np.exp(-2 * x)
        below = x * (1 - 2 * (1 + 2 * x * x) * e2 + e2 * e2)
        r, b = (1 + 4 * x * e2 - e2 * e2) / below, 2 * e1 * ((x + 1) + (x - 1) * e2) / below
        a = (kx * along + ky * across) * thickness
        den = delta * (r * r - b * b) - stretch * (delta + 1) * r + stretch**2 - a * a + 1j * (a * (delta + 1) * r - 2 * stretch * a)
        limit = stretch - delta / (2 * (delta + 1))
        if part == "surface":
            return np.where(kh > 0, -delta * b / den, delta / (delta + 1) / limit)
        return np.where(kh > 0, ((r - stretch) + 1j * a) / den, -1 / (delta + 1) / limit)

    return multiplier
