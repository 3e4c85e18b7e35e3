"""Spectra of a whole small grid: one group, in numpy. A transform needs all of a grid, so larger areas come as fields of their own (tiles)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def radial_spectrum(grid: DataFrame, field: str, v: str, step: float, bins: int) -> DataFrame:
    """Mean power by wavenumber bin of each field (a column that names the grid); nulls count as the field's mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(pdf["iy"].max()) + 1, int(pdf["ix"].max()) + 1
        a = np.full((ny, nx), np.nan)
        a[pdf["iy"], pdf["ix"]] = pdf[v]
        a = np.where(np.isfinite(a), a, np.nanmean(a)) - np.nanmean(a)
        power = np.abs(np.fft.fft2(a)) ** 2 / (ny * nx)
        k = np.hypot(np.fft.fftfreq(ny, step)[:, None], np.fft.fftfreq(nx, step)[None])
        b = np.minimum((k / (0.5 / step) * bins).astype(int), bins - 1).ravel()
        n = np.bincount(b, minlength=bins)
        return pd.DataFrame({field: pdf[field].iloc[0], "bin": np.arange(bins), "n": n, "power": np.bincount(b, power.ravel(), bins) / np.maximum(n, 1)})

    kinds = dict(grid.dtypes)
    return grid.groupBy(field).applyInPandas(run, f"{field} {kinds[field]}, bin int, n long, power double")


def _doubled(a: np.ndarray) -> np.ndarray:
    """The field with its mirror image on each axis, which makes it periodic without a jump."""
    a = np.concatenate([a, a[::-1]])
    return np.concatenate([a, a[:, ::-1]], axis=1)


def apply_multiplier(grid: DataFrame, field: str, v: str, step: float, multiplier) -> DataFrame:
    """(field, iy, ix, v) of each field after its transform is multiplied by multiplier(ky, kx) (radians a metre, numpy in and out).

    One small grid a group. Nulls count as the field's mean and stay null. The field is mirrored first, so its edges don't wrap around.
    A group without any value gives nulls.
    """
    kinds = dict(grid.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = pdf["iy"].to_numpy(), pdf["ix"].to_numpy()
        a = np.full((int(iy.max()) + 1, int(ix.max()) + 1), np.nan)
        a[iy, ix] = pdf[v].astype(float)
        out = a
        if np.isfinite(a).any():
            d = _doubled(np.where(np.isfinite(a), a, np.nanmean(a)))
            ky, kx = (2 * np.pi * np.fft.fftfreq(n, step) for n in d.shape)
            filtered = np.fft.ifft2(np.fft.fft2(d) * multiplier(ky[:, None], kx[None])).real[: a.shape[0], : a.shape[1]]
            out = np.where(np.isfinite(a), filtered, np.nan)
        values = pd.Series(out[iy, ix])
        return pd.DataFrame({field: pdf[field].to_numpy(), "iy": iy, "ix": ix, v: values.astype(object).where(values.notna(), None)})

    return grid.select(field, "iy", "ix", v).groupBy(field).applyInPandas(run, f"{field} {kinds[field]}, iy int, ix int, {v} double")


def helmholtz_divergence(grid: DataFrame, field: str, qx: str, qy: str, step: float, length: float | None = None, fill: float = 2.0) -> DataFrame:
    """(field, iy, ix, divergence, length) of each field's flux, from the part of it that converges alone: its transform along the wave vector,
    held down by 1 / (1 + (k length)^4). y falls with iy.

    length None: of sixteen lengths from half a cell to sixteen cells the one with the least generalised cross-validation error of that part.
    Gaps are filled by a Gaussian mean of `fill` cells (four times as wide far from values) for the transform, and stay null. One grid a group.
    """
    kinds = dict(grid.dtypes)

    def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
        reach = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        w /= w.sum()
        for axis in (0, 1):
            a = np.apply_along_axis(lambda line: np.convolve(np.pad(line, reach, "symmetric") if reach <= len(line) else np.pad(line, reach, "edge"), w, "valid"), axis, a)
        return a

    def filled(a: np.ndarray) -> np.ndarray:
        known = np.isfinite(a)
        if known.all():
            return a
        a0, out = np.where(known, a, 0.0), np.zeros_like(a)
        for sigma in (4 * fill, fill):
            have = blurred(known.astype(float), sigma)
            out = np.where(have > 1e-3, blurred(a0, sigma) / np.maximum(have, 1e-12), out)
        return np.where(known, a, out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = pdf["iy"].to_numpy(), pdf["ix"].to_numpy()
        both = []
        for c in (qx, qy):
            a = np.full((int(iy.max()) + 1, int(ix.max()) + 1), np.nan)
            a[iy, ix] = pdf[c].astype(float)
            both.append(a)
        known = np.isfinite(both[0]) & np.isfinite(both[1])
        hat = [np.fft.fft2(_doubled(filled(a))) for a in both]
        ky, kx = (2 * np.pi * np.fft.fftfreq(2 * n, step) for n in known.shape)
        ky, kx = -ky[:, None], kx[None]
        k = np.hypot(ky, kx)
        flow = kx * hat[0] + ky * hat[1]
        least, used = np.inf, length
        if length is None:
            along = np.abs(np.where(k > 0, flow / np.where(k > 0, k, 1.0), 0.0)) ** 2
            for cells in np.logspace(np.log10(0.5), np.log10(16.0), 16):
                f = low_pass(cells * step)(ky, kx)
                error = float(((1 - f) ** 2 * along).sum()) / max(1 - float(f.mean()), 1e-9) ** 2
                if error < least:
                    least, used = error, cells * step
        out = np.fft.ifft2(1j * flow * (low_pass(used)(ky, kx) if used > 0 else 1.0)).real[: known.shape[0], : known.shape[1]]
        values = pd.Series(np.where(known, out, np.nan)[iy, ix])
        return pd.DataFrame({field: pdf[field].to_numpy(), "iy": iy, "ix": ix, "divergence": values.astype(object).where(values.notna(), None), "length": float(used)})

    return grid.select(field, "iy", "ix", qx, qy).groupBy(field).applyInPandas(run, f"{field} {kinds[field]}, iy int, ix int, divergence double, length double")


def damped_inverse(response, damping: float):
    """The multiplier that undoes a response where it is strong and leaves out what it has nearly wiped out."""

    def multiplier(ky: np.ndarray, kx: np.ndarray) -> np.ndarray:
        r = response(ky, kx)
        return np.conj(r) / (np.abs(r) ** 2 + damping)

    return multiplier


def low_pass(length: float):
    """1 / (1 + (k length)^4): waves much longer than length stay."""
    return lambda ky, kx: 1 / (1 + (np.hypot(ky, kx) * length) ** 4)
