"""Mass budgets of floating ice: in a fixed frame (per cell) and along moving parcels. Rates are metres of ice a year; negative is loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import MAD_TO_SIGMA, TUKEY_C, thickness

from .grid import flux_divergence
from .stats import trend


def eulerian(cells: DataFrame, grid: DataFrame, step: float, min_count: int = 3) -> DataFrame:
    """From heights (iy, ix, t seconds, z) and a dense grid (iy, ix, vx, vy, a_dot): dH/dt + div(H v) - a_dot for each cell."""
    h = cells.withColumn("H", thickness(F.col("z")))
    fit = trend(h, ["iy", "ix"], "t", "H", min_count).select("iy", "ix", F.col("slope").alias("dhdt"), "n", "rmse")
    mean = h.groupBy("iy", "ix").agg(F.avg("H").alias("H"))
    field = grid.join(mean, ["iy", "ix"], "left").join(fit, ["iy", "ix"], "left")
    return flux_divergence(field, "H", "vx", "vy", step).select("iy", "ix", "dhdt", "divergence", "n", "rmse", (F.col("dhdt") + F.col("divergence") - F.col("a_dot")).alias("rate"))


def gather(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of a (ny, nx) field at cell coordinates; NaN outside."""
    ny, nx = field.shape
    ok = (y >= 0) & (x >= 0) & (y <= ny - 1) & (x <= nx - 1)
    yy, xx = np.where(ok, y, 0), np.where(ok, x, 0)
    y0, x0 = np.minimum(yy.astype(int), max(ny - 2, 0)), np.minimum(xx.astype(int), max(nx - 2, 0))
    wy, wx = yy - y0, xx - x0
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    v = field[y0, x0] * (1 - wy) * (1 - wx) + field[y0, x1] * (1 - wy) * wx + field[y1, x0] * wy * (1 - wx) + field[y1, x1] * wy * wx
    return np.where(ok, v, np.nan)


def lagrangian(starts: DataFrame, shape: tuple[int, int], step: float, dt_yr: float = 0.05, output: str = "path") -> DataFrame:
    """Rates of parcels between a start epoch and its partners: (start, partner, iy, ix, n, mean), partners numbered by their time.

    starts has a row for each start epoch (and tile): start, and flat arrays (row by row) H0, vx, vy, div, a_dot and, as arrays of structs,
    partners (dt, H1) and, where the velocity varies, flow (t, vx, vy), t in years from the start: between two of them it is linear in time, and
    beyond the first and last it is theirs. A parcel leaves each cell with a value; velocity and divergence are taken where a sub-step starts;
    accumulation is the seed cell's. One path of the farthest partner serves all partners of a start. A parcel whose velocity is unknown or that
    leaves the grid ends there.

    output "path": a sub-step's rate goes to the cell where the sub-step ends, and a cell's are averaged. "origin": a parcel's mean rate over its
    path goes to the cell that it left; a parcel that ended early has none. Then pair_median() over pairs.
    """
    if output not in ("path", "origin"):
        raise ValueError("output: path or origin")
    ny, nx = shape
    rows = starts if "flow" in starts.columns else starts.withColumn("flow", F.lit(None).cast("array<struct<t:double,vx:array<double>,vy:array<double>>>"))

    def field(a) -> np.ndarray:
        return np.asarray(a, float).reshape(ny, nx)

    def velocity(r):
        """The fields at a time, interpolated between the two epochs around it."""
        if r.flow is None or not len(r.flow):
            vx, vy = field(r.vx), field(r.vy)
            return lambda t: (vx, vy)
        known = sorted(((float(f["t"]), field(f["vx"]), field(f["vy"])) for f in r.flow), key=lambda f: f[0])
        times = [k[0] for k in known]

        def at(t: float) -> tuple[np.ndarray, np.ndarray]:
            j = int(np.clip(np.searchsorted(times, t, "right"), 1, max(len(times) - 1, 1)))
            if len(times) == 1:
                return known[0][1:]
            u = min(max((t - times[j - 1]) / (times[j] - times[j - 1]), 0.0), 1.0)
            return tuple(known[j - 1][c] if u == 0 else known[j][c] if u == 1 else (1 - u) * known[j - 1][c] + u * known[j][c] for c in (1, 2))

        return at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                h0, div, acc = field(r.H0), field(r.div), field(r.a_dot)
                flow = velocity(r)
                first = flow(0.0)
                sy, sx = np.nonzero(np.isfinite(h0) & np.isfinite(first[0]) & np.isfinite(first[1]))
                seed_h, seed_a = h0[sy, sx], acc[sy, sx]
                y, x, live = sy.astype(float), sx.astype(float), np.ones(len(sy), bool)
                partners = sorted(((float(p["dt"]), field(p["H1"])) for p in r.partners), key=lambda p: p[0])
                steps = max((max(1, int(np.rint(dt / dt_yr))) for dt, _ in partners), default=0)
                cells, divs, alive, ends = [], [], [], []
                for k in range(steps):
                    vx, vy = flow(k * dt_yr)
                    u, v, d = gather(vx, y, x), gather(vy, y, x), gather(div, y, x)
                    live = live & np.isfinite(u) & np.isfinite(v)
                    x, y = np.where(live, x + u * dt_yr / step, x), np.where(live, y - v * dt_yr / step, y)
                    cy, cx = np.rint(y), np.rint(x)
                    live = live & (cy >= 0) & (cy <= ny - 1) & (cx >= 0) & (cx <= nx - 1)
                    cells.append(np.where(live, cy * nx + cx, -1).astype(int))
                    divs.append(d)
                    alive.append(live)
                    ends.append((y.copy(), x.copy()))
                for number, (dt, h1) in enumerate(partners):
                    k = max(1, int(np.rint(dt / dt_yr)))
                    end = gather(h1, *ends[k - 1])
                    total, count = np.zeros(ny * nx), np.zeros(ny * nx)
                    own = np.zeros(len(sy))
                    for j in range(k):
                        at = seed_h + (end - seed_h) * ((j + 1) * dt_yr / dt)
                        rate = (end - seed_h) / dt + at * divs[j] - seed_a
                        ok = alive[j] & np.isfinite(rate)
                        if output == "path":
                            total += np.bincount(cells[j][ok], rate[ok], ny * nx)
                            count += np.bincount(cells[j][ok], minlength=ny * nx)
                        own = own + np.where(ok, rate, np.nan)
                    if output == "origin":
                        whole = np.isfinite(own)
                        total[sy[whole] * nx + sx[whole]], count[sy[whole] * nx + sx[whole]] = own[whole] / k, 1
                    hit = np.flatnonzero(count)
                    yield pd.DataFrame({"start": r.start, "partner": number, "iy": hit // nx, "ix": hit % nx, "n": count[hit].astype(int), "mean": total[hit] / count[hit]})

    return rows.mapInPandas(run, "start long, partner long, iy int, ix int, n long, mean double")


def pair_median(deposits: DataFrame) -> DataFrame:
    """Median over pairs of each pair's mean in a cell; the count is that of all deposits."""
    return deposits.groupBy("iy", "ix").agg(F.median("mean").alias("rate"), F.sum("n").alias("n"), F.count("*").alias("pairs"))


def parcel_rates(tiles: DataFrame, shape: tuple[int, int], step: float, dt_yr: float = 0.05, min_epochs: int = 4, min_span: float = 1.0, least: float = 1.0, rounds: int = 8, tol: float = 1e-3) -> DataFrame:
    """(tile, iy, ix, rate, n, span, rmse, stderr): for the parcel that leaves each cell at the first time, one robust line over every epoch that
    its path crosses.

    tiles has a row for each tile: tile, times (years from the first), H (an array of flat grids, one a time) and flat arrays vx, vy, div, a_dot.
    A parcel's footprint stretches by s = exp(sum of div dt); its thickness times s, less the accumulation times s that came on the way, grows
    along the stretched time (sum of s dt) by the rate. Thicknesses of `least` or less don't count. Parcels with fewer than min_epochs values, or
    whose values span less than min_span years, have no row. rounds 0: plain least squares. A tile is one row, so work spreads by tiles.
    """
    ny, nx = shape
    kinds = dict(tiles.dtypes)

    def lines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slope, values, residuals' spread and the slope's error for each column, by Tukey's weights; y is NaN where there is no value."""
        there = np.isfinite(y)
        x0, y0 = np.where(there, x, 0.0), np.where(there, y, 0.0)
        w, slope = there.astype(float), np.zeros(y.shape[1])
        for turn in range(rounds + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                sw = w.sum(0)
                mx, my = (w * x0).sum(0) / sw, (w * y0).sum(0) / sw
                sxx = (w * (x0 - mx) ** 2).sum(0)
                new = (w * (x0 - mx) * (y0 - my)).sum(0) / sxx
            left = np.where(there, y - my - new * (x - mx), np.nan)
            done = turn and np.nanmax(np.abs(new - slope), initial=0.0) <= tol * max(np.nanmax(np.abs(new), initial=0.0), 1e-12)
            slope = new
            if done or turn == rounds:
                break
            mid = np.nanmedian(left, axis=0)
            scale = MAD_TO_SIGMA * np.nanmedian(np.abs(left - mid), axis=0) + 1e-9
            u = np.where(there, left, 0.0) / (TUKEY_C * scale)
            some = np.where(there & (np.abs(u) < 1), (1 - u**2) ** 2, 0.0)
            w = np.where((some > 0).sum(0) >= 3, some, w)  # never fewer than a line needs
        n = there.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt((w * np.where(there, left, 0.0) ** 2).sum(0) / np.maximum(w.sum(0) - 2, 1e-9))
            return slope, n, spread, spread / np.sqrt(sxx)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                vx, vy, div, acc = (np.asarray(getattr(r, c), float).reshape(ny, nx) for c in ("vx", "vy", "div", "a_dot"))
                order = np.argsort(r.times)
                times, heights = np.asarray(r.times, float)[order], [np.asarray(r.H[k], float).reshape(ny, nx) for k in order]
                sy, sx = np.nonzero(np.isfinite(vx) & np.isfinite(vy))
                y, x, live = sy.astype(float), sx.astype(float), np.ones(len(sy), bool)
                stretch, added, clock, at = np.ones(len(sy)), np.zeros(len(sy)), np.zeros(len(sy)), 0
                stops, taus, values = [max(0, int(np.rint((t - times[0]) / dt_yr))) for t in times], [], []
                for t, stop, h in zip(times, stops, heights, strict=True):
                    while at < stop:
                        u, v, d, a = (gather(f, y, x) for f in (vx, vy, div, acc))
                        live = live & np.isfinite(u) & np.isfinite(v) & np.isfinite(d)
                        grown = stretch * np.exp(np.where(live, d, 0.0) * dt_yr)
                        mean = (stretch + grown) / 2
                        clock, added, stretch = clock + mean * dt_yr, added + np.where(np.isfinite(a), a, 0.0) * mean * dt_yr, grown
                        x, y, at = np.where(live, x + u * dt_yr / step, x), np.where(live, y - v * dt_yr / step, y), at + 1
                    seen = gather(h, y, x)
                    taus.append(clock)
                    values.append(np.where(live & (seen > least), seen * stretch - added, np.nan))
                tau, value = np.array(taus), np.array(values)
                there = np.isfinite(value)
                when = np.where(there, times[:, None], np.nan)
                with np.errstate(all="ignore"):
                    span = np.where(there.any(0), np.nanmax(np.where(there, when, -np.inf), 0) - np.nanmin(np.where(there, when, np.inf), 0), 0.0)
                ok = (there.sum(0) >= min_epochs) & (span >= min_span)
                if not ok.any():
                    continue
                slope, n, spread, error = lines(tau[:, ok], value[:, ok])
                yield pd.DataFrame({"tile": r.tile, "iy": sy[ok], "ix": sx[ok], "rate": slope, "n": n, "span": span[ok], "rmse": spread, "stderr": error})

    return tiles.mapInPandas(run, f"tile {kinds['tile']}, iy int, ix int, rate double, n long, span double, rmse double, stderr double")
