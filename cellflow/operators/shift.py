"""The position error of a height grid against control points: shifts by least squares over gathered slopes, repeated until they are small."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import MAD_TO_SIGMA, TUKEY_C

from .gates import slope_aspect
from .grid import differentiate, gather_fields
from .stats import median_of_all


def robust_lsq(rows: DataFrame, columns: list[Column], b: Column, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of b on the columns by Tukey's weights, their standard errors, and the residuals' scaled median deviation.

    A round is one aggregate of products and the medians. An error is infinite where the rows leave a direction open. Weights that leave fewer
    rows than unknowns go back to equal ones.
    """
    n = len(columns)
    parts = rows.select(*[c.cast("double").alias(f"a{i}") for i, c in enumerate(columns)], b.cast("double").alias("b")).dropna()
    fit = lambda x: sum((float(v) * F.col(f"a{i}") for i, v in enumerate(x)), F.lit(0.0))

    def normal(w: Column) -> tuple[np.ndarray, np.ndarray, float]:
        r = parts.withColumn("w", w).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"a{i}") * F.col(f"a{j}")).alias(f"s{i}{j}") for i in range(n) for j in range(i, n)], *[F.sum(F.col("w") * F.col(f"a{i}") * F.col("b")).alias(f"t{i}") for i in range(n)]).first()
        if r["w"] is None:
            raise ValueError("no full rows")
        m = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(n)] for i in range(n)])
        return m, np.array([r[f"t{i}"] for i in range(n)]), r["w"]

    m, t, _ = normal(F.lit(1.0))
    scale = math.nan
    for k in range(rounds):
        x = np.linalg.lstsq(m, t, rcond=None)[0]
        e = F.col("b") - fit(x)
        left = parts.select(e.alias("e"))
        mid = median_of_all(left, "e")
        scale = MAD_TO_SIGMA * (median_of_all(left.select(F.abs(F.col("e") - mid).alias("d")), "d") + 1e-12)
        u = e / (TUKEY_C * scale)
        last = normal(F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0))
        if last[2] < n + 1:
            m, t, _ = normal(F.lit(1.0))
            break
        if k < rounds - 1:
            m, t, _ = last
        else:
            m = last[0]
    values, vectors = np.linalg.eigh(m)
    good = values > np.abs(values).max() * n * np.finfo(float).eps
    var = (vectors[:, good] ** 2) @ (1 / values[good])
    var = np.where((vectors[:, ~good] ** 2).sum(1) > 1e-12, np.inf, var)
    return x, scale * np.sqrt(var), scale


def shift_to_points(heights: DataFrame, points: DataFrame, origin: tuple[float, float], step: float, method: str = "gradient", rounds: int = 10, tol: float = 0.01, slopes: tuple[float, float] = (3.0, 60.0), least: int = 30, keep=None) -> dict:
    """dx, dy, dz by which a height grid (iy, ix, v; dense, rows north to south) is off control points (id, x, y, z).

    origin: centre of cell (0, 0). Points on slopes between the two limits (degrees) count. gradient: heights' differences on the surface's
    gradient; cosine: differences over the slope's tangent on the aspect's sine and cosine. Rounds end when the step is under tol; with fewer
    than `least` points on the first round the shift is None. Also se_dx, se_dy, se_dz, rounds, converged, n_points, nmad_before and nmad_after
    (over the first round's points).
    """
    if method not in ("gradient", "cosine"):
        raise ValueError("method: gradient or cosine")
    keep = keep or (lambda df: df)
    east = heights.select("iy", "ix", "v", differentiate(heights, "v", "ix", step).alias("gx"))
    north = heights.select("iy", "ix", (-differentiate(heights, "v", "iy", step)).alias("gy"))
    terrain = east.join(north, ["iy", "ix"]).join(slope_aspect(heights, "v", step), ["iy", "ix"])
    terrain = keep(terrain.select("iy", "ix", "v", "gx", "gy", "slope", F.sin("aspect").alias("sa"), F.cos("aspect").alias("ca")))
    fields = ["v", "gx", "gy", "slope", "sa", "ca"]
    total, out, first = np.zeros(3), {"dx": None, "dy": None, "dz": None, "converged": False, "rounds": 0, "n_points": 0}, None

    def at(shift: np.ndarray) -> DataFrame:
        """The points' differences and slopes where the shift puts them."""
        placed = points.select("id", "z", ((origin[1] - (F.col("y") + float(shift[1]))) / step).alias("fy"), ((F.col("x") + float(shift[0]) - origin[0]) / step).alias("fx"))
        seen = gather_fields(placed, terrain, fields).join(placed.select("id", "z"), "id")
        return seen.withColumn("dh", F.col("v") - F.col("z") - float(shift[2]))

    def spread(df: DataFrame) -> float:
        mid = median_of_all(df, "dh")
        return MAD_TO_SIGMA * median_of_all(df.select(F.abs(F.col("dh") - mid).alias("d")), "d")

    low, high = (math.radians(s) for s in slopes)
    for turn in range(rounds):
        here = keep(at(total).where(F.col("dh").isNotNull() & F.col("slope").between(low, high)))
        n = here.count()
        if n < least:
            out["n_points"] = out["n_points"] or n
            break
        if turn == 0:
            first = keep(here.select("id"))
            out["nmad_before"] = spread(here)
        if method == "cosine":
            rise = F.tan("slope")
            x, se, _ = robust_lsq(here, [F.col("sa"), F.col("ca"), F.lit(1.0)], F.col("dh") / rise)
            mean = here.agg(F.avg(rise)).first()[0]
            x, se = x * [1, 1, mean], se * [1, 1, mean]
        else:
            x, se, _ = robust_lsq(here, [-F.col("gx"), -F.col("gy"), F.lit(1.0)], F.col("dh"))
        total = total + x
        out |= {"se_dx": float(se[0]), "se_dy": float(se[1]), "se_dz": float(se[2]), "rounds": turn + 1, "n_points": n}
        if math.hypot(x[0], x[1]) < tol:
            out["converged"] = True
            break
    if out["rounds"]:
        out |= dict(zip(("dx", "dy", "dz"), map(float, total), strict=True))
        out["nmad_after"] = spread(at(total).where("dh is not null").join(first, "id", "left_semi"))
    return out
