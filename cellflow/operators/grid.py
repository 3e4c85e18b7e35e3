"""Operators on grids in long form: (iy, ix, v), with a row for each cell where a stencil needs neighbours. Stencils are windows along rows
or columns, so a grid is spread by its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def densify(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """A row for each of ny x nx cells; a cell without one gets null."""
    ids = cells.sparkSession.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return ids.join(cells, ["iy", "ix"], "left")


def differentiate(grid: DataFrame, v: str, along: str, step: float) -> Column:
    """Central difference inside and one-sided at the ends of each line; null next to a null."""
    across = "iy" if along == "ix" else "ix"
    w = Window.partitionBy(across).orderBy(along)
    ahead, back = F.lead(v).over(w), F.lag(v).over(w)
    first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    return F.when(first, (ahead - F.col(v)) / step).when(last, (F.col(v) - back) / step).otherwise((ahead - back) / (2 * step))


def flux_divergence(grid: DataFrame, thickness: str, vx: str, vy: str, step: float, estimator=None) -> DataFrame:
    """grid with divergence: d(H vx)/dx + d(H vy)/dy; y descends with iy. estimator: another way to it, a function of (grid with the columns
    _fx and _fy, the two fluxes; step) that returns (iy, ix, divergence)."""
    g = grid.withColumn("_fx", F.col(thickness) * F.col(vx)).withColumn("_fy", F.col(thickness) * F.col(vy))
    if estimator is not None:
        return grid.join(estimator(g, step).select("iy", "ix", "divergence"), ["iy", "ix"], "left")
    g = g.withColumn("_dx", differentiate(g, "_fx", "ix", step))
    return g.withColumn("divergence", F.col("_dx") - differentiate(g, "_fy", "iy", step)).drop("_fx", "_fy", "_dx")


def harmonic_infill(grid: DataFrame, field: str, v: str, inside: str, tol: float = 1e-10) -> DataFrame:
    """(field, iy, ix, v) of the cells inside: gaps take the solution of Laplace's equation with the values around them, and no flow across the
    domain's edge. A gap that touches no value takes the mean of all that have one; without any value it stays null. One field a group, solved
    by conjugate gradients until the residual is `tol` of its start.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(grid.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = pdf["iy"].to_numpy(), pdf["ix"].to_numpy()
        a, domain = np.full((int(iy.max()) + 3, int(ix.max()) + 3), np.nan), np.zeros((int(iy.max()) + 3, int(ix.max()) + 3), bool)  # a rim outside
        domain[iy + 1, ix + 1] = pdf[inside].fillna(False).astype(bool)
        a[iy + 1, ix + 1] = pdf[v].astype(float)
        gap, steps = domain & ~np.isfinite(a), ((0, 1), (0, -1), (1, 1), (1, -1))
        if gap.any() and (domain & ~gap).any():
            known = np.where(domain & ~gap, a, 0.0)
            degree = sum(np.roll(domain, s, axis).astype(float) for axis, s in steps)
            # Gaps that no value reaches are solved by their ridge alone and then replaced.
            reached = domain & ~gap
            while True:
                more = reached | (gap & (sum(np.roll(reached, s, axis).astype(int) for axis, s in steps) > 0))
                if (more == reached).all():
                    break
                reached = more
            solve = gap & reached
            product = lambda x: np.where(solve, degree * x - sum(np.roll(np.where(solve, x, 0.0), s, axis) for axis, s in steps), 0.0)
            b = np.where(solve, sum(np.roll(known, s, axis) for axis, s in steps), 0.0)
            x = np.where(solve, np.nanmean(a[domain]), 0.0)
            r = b - product(x)
            p, size = r.copy(), (r * r).sum()
            first = size
            for _ in range(20 * int(solve.sum()) + 50):
                if size <= tol * tol * max(first, 1e-300):
                    break
                q = product(p)
                alpha = size / (p * q).sum()
                x, r = x + alpha * p, r - alpha * q
                size, before = (r * r).sum(), size
                p = r + size / before * p
            a = np.where(solve, x, np.where(gap, np.nanmean(np.where(domain & ~gap, a, np.nan)), a))
        keep = domain[iy + 1, ix + 1]
        values = pd.Series(a[iy + 1, ix + 1][keep])
        return pd.DataFrame({field: pdf[field].to_numpy()[keep], "iy": iy[keep], "ix": ix[keep], v: values.astype(object).where(values.notna(), None)})

    return grid.select(field, "iy", "ix", v, inside).groupBy(field).applyInPandas(run, f"{field} {kinds[field]}, iy int, ix int, {v} double")


def box_mean(grid: DataFrame, v: str, size: int) -> DataFrame:
    """Mean over a size x size box, cells beyond the edge as the nearest cell (a line at a time: the box is separable)."""
    for along, across in (("ix", "iy"), ("iy", "ix")):
        lo, hi = -(size // 2), size - 1 - size // 2
        w = Window.partitionBy(across).orderBy(along)
        total = F.sum(v).over(w.rowsBetween(lo, hi))
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.greatest(F.lit(0), -lo - (F.col(along) - F.min(along).over(whole)))
        after = F.greatest(F.lit(0), hi - (F.max(along).over(whole) - F.col(along)))
        grid = grid.withColumn("_m", (total + before * F.first(v).over(whole) + after * F.last(v).over(whole)) / size).withColumn(v, F.col("_m")).drop("_m")
    return grid


def gaussian_mean(grid: DataFrame, v: str, sigma: float, reach: int) -> DataFrame:
    """Gaussian-weighted mean of the cells with a value within `reach` cells each way: neighbours are found by key, not by distance."""
    offsets = grid.sparkSession.range((2 * reach + 1) ** 2).select((F.floor(F.col("id") / (2 * reach + 1)) - reach).cast("int").alias("dy"), (F.col("id") % (2 * reach + 1) - reach).cast("int").alias("dx"))
    weight = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.lit(2 * sigma * sigma))
    spread = grid.where(F.col(v).isNotNull()).crossJoin(F.broadcast(offsets)).select((F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix"), (weight * F.col(v)).alias("_wv"), weight.alias("_w"))
    sums = spread.groupBy("iy", "ix").agg((F.sum("_wv") / F.sum("_w")).alias("smooth"))
    return grid.join(sums, ["iy", "ix"], "left")


def blended(labels: DataFrame, label: str, sigma: float, reach: int) -> DataFrame:
    """(iy, ix, label, weight): for each labelled cell how much of each label lies about it, by Gaussian weights within `reach` cells each way; a
    cell's weights add up to 1."""
    offsets = labels.sparkSession.range((2 * reach + 1) ** 2).select((F.floor(F.col("id") / (2 * reach + 1)) - reach).cast("int").alias("dy"), (F.col("id") % (2 * reach + 1) - reach).cast("int").alias("dx"))
    weight = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.lit(2 * sigma * sigma))
    some = labels.where(F.col(label).isNotNull())
    spread = some.crossJoin(F.broadcast(offsets)).select((F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix"), label, weight.alias("_w"))
    sums = spread.groupBy("iy", "ix", label).agg(F.sum("_w").alias("_w")).join(some.select("iy", "ix"), ["iy", "ix"], "left_semi")
    return sums.select("iy", "ix", label, (F.col("_w") / F.sum("_w").over(Window.partitionBy("iy", "ix"))).alias("weight"))


def gather_bilinear(points: DataFrame, grid: DataFrame, v: str, clamp: tuple[int, int] | None = None) -> DataFrame:
    """For points (id, fy, fx in cells) the value between their four cells; null outside or where one of the four is null. clamp: the grid's
    (rows, columns); points outside then take the value at the nearest place on its edge. Four keys a point are joined and summed: no search."""
    fy, fx = F.col("fy"), F.col("fx")
    if clamp:
        fy, fx = (F.least(F.greatest(c, F.lit(0.0)), F.lit(n - 1.0)) for c, n in ((fy, clamp[0]), (fx, clamp[1])))
    y0, x0 = F.floor(fy).cast("int"), F.floor(fx).cast("int")
    wy, wx = fy - y0, fx - x0
    corner = lambda dy, dx, w: F.struct((y0 + dy).alias("iy"), (x0 + dx).alias("ix"), w.alias("w"))
    four = points.select("id", F.explode(F.array(corner(0, 0, (1 - wy) * (1 - wx)), corner(0, 1, (1 - wy) * wx), corner(1, 0, wy * (1 - wx)), corner(1, 1, wy * wx))).alias("c")).select("id", "c.*").where("w > 0")
    got = four.join(grid.select("iy", "ix", F.col(v).alias("_v")), ["iy", "ix"], "left").groupBy("id").agg(F.sum(F.col("w") * F.col("_v")).alias("value"), F.bool_and(F.col("_v").isNotNull()).alias("_all"))
    return got.select("id", F.when(F.col("_all"), F.col("value")).alias("value"))


def gather_fields(points: DataFrame, grid: DataFrame, fields: list[str]) -> DataFrame:
    """(id, fields): gather_bilinear for several fields at once; a field is null where one of its four cells is."""
    y0, x0 = F.floor("fy").cast("int"), F.floor("fx").cast("int")
    wy, wx = F.col("fy") - y0, F.col("fx") - x0
    corner = lambda dy, dx, w: F.struct((y0 + dy).alias("iy"), (x0 + dx).alias("ix"), w.alias("w"))
    four = points.select("id", F.explode(F.array(corner(0, 0, (1 - wy) * (1 - wx)), corner(0, 1, (1 - wy) * wx), corner(1, 0, wy * (1 - wx)), corner(1, 1, wy * wx))).alias("c")).select("id", "c.*").where("w > 0")
    met = four.join(grid.select("iy", "ix", *[F.col(c).alias(f"_{c}") for c in fields]), ["iy", "ix"], "left")
    return met.groupBy("id").agg(*[F.when(F.bool_and(F.col(f"_{c}").isNotNull()), F.sum(F.col("w") * F.col(f"_{c}"))).alias(c) for c in fields])


def gather_index(points: DataFrame, grid: DataFrame, v: str, how: str = "nearest") -> DataFrame:
    """The value of the nearest cell (halves to even) or of the next cell up (`ceiling`, as a search in sorted coordinates gives)."""
    index = {"nearest": F.rint, "ceiling": F.ceil}[how]
    return points.select("id", index("fy").cast("int").alias("iy"), index("fx").cast("int").alias("ix")).join(grid.select("iy", "ix", F.col(v).alias("value")), ["iy", "ix"], "left").select("id", "value")
