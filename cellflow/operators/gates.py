"""Gates, masks and merges over cells and points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import SECONDS_PER_YEAR

from .grid import differentiate, gaussian_mean


def slope_aspect(grid: DataFrame, v: str, step: float) -> DataFrame:
    """iy, ix, slope and aspect (radians; downhill, clockwise from north) of a dense grid whose rows run north to south."""
    east = grid.select("iy", "ix", differentiate(grid, v, "ix", step).alias("gx"), (-differentiate(grid, v, "iy", step)).alias("gy"))
    return east.select("iy", "ix", F.atan(F.hypot("gx", "gy")).alias("slope"), F.pmod(F.atan2(-F.col("gx"), -F.col("gy")), F.lit(2 * math.pi)).alias("aspect"))


def away_from(grid: DataFrame, inside: Column, shore: Column, distance: float, step: float) -> DataFrame:
    """iy, ix of the cells inside that lie farther than distance from every shore cell. A null condition doesn't hold.

    Only shore cells beside one that isn't shore can be nearest. Each of them strikes out the cells of a disc around it, so the work is
    the shore's length times the disc, and cells meet by equality.
    """
    cells = grid.select("iy", "ix", F.coalesce(inside, F.lit(False)).alias("inside"), F.coalesce(shore, F.lit(False)).alias("shore"))
    reach = int(distance / step)
    if distance <= 0:
        return cells.where("inside").select("iy", "ix")
    shores = cells.where("shore").select("iy", "ix")
    four = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    ringed = shores.select("iy", "ix", four.alias("o")).select((F.col("iy") + F.col("o.y")).alias("iy"), (F.col("ix") + F.col("o.x")).alias("ix")).groupBy("iy", "ix").agg(F.count("*").alias("n"))
    # A shore cell all of whose neighbours are shore is counted by each of the four.
    border = shores.join(ringed.where("n = 4"), ["iy", "ix"], "left_anti")
    disc = [(y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1) if math.hypot(y, x) * step <= distance]
    offsets = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in disc])).alias("o")
    near = border.select("iy", "ix", offsets).select((F.col("iy") + F.col("o.y")).alias("iy"), (F.col("ix") + F.col("o.x")).alias("ix")).distinct()
    return cells.where("inside").select("iy", "ix").join(near, ["iy", "ix"], "left_anti")


def common_epoch_mean(cells: DataFrame, slopes: DataFrame, key: str | list[str], t: str, z: str, at: float | None = None, sigma: float = 0.0) -> DataFrame:
    """(key, mean): each cell's mean of z moved along its slope (a year) from its own mean time to the time `at`, which is else the mean of
    all epochs. t is in seconds.

    sigma: the slopes are first a Gaussian mean of so many cells (key is then iy and ix), within four times as far; a cell without a slope takes
    its neighbours'. Cells that then have none keep their plain mean.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if at is None:
        at = cells.select(t).distinct().agg(F.avg(t)).first()[0] or 0.0
    mean = cells.where(F.col(z).isNotNull()).groupBy(*keys).agg(F.avg(z).alias("_z"), F.avg(F.col(t) - at).alias("_lever"))
    if sigma > 0:
        if keys != ["iy", "ix"]:
            raise ValueError("smoothed slopes need the keys iy and ix")
        slopes = gaussian_mean(mean.select("iy", "ix").join(slopes.select("iy", "ix", "slope"), ["iy", "ix"], "left"), "slope", sigma, int(4 * sigma + 0.5)).select("iy", "ix", F.col("smooth").alias("slope"))
    return mean.join(slopes.select(*keys, "slope"), keys, "left").select(*keys, (F.col("_z") - F.coalesce(F.col("slope") * F.col("_lever") / SECONDS_PER_YEAR, F.lit(0.0))).alias("mean"))


def covered(cells: DataFrame, key: str, epoch: str, z: str, share: float) -> DataFrame:
    """(key, epochs): cells that have a value in at least `share` of all epochs."""
    total = cells.select(epoch).distinct().count()
    return cells.where(F.col(z).isNotNull()).groupBy(key).agg(F.count_distinct(epoch).alias("epochs")).where(F.col("epochs") >= share * total)


def spread_gate(points: DataFrame, key: str, x: str, y: str, least: int, least_y: float, least_x: float) -> DataFrame:
    """(key, n, passed, reason): enough points, spread widely enough to hold a plane. The first check that fails names the reason."""
    g = points.groupBy(key).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), (F.max(y) - F.min(y)).alias("_y"), (F.max(x) - F.min(x)).alias("_x"))
    reason = F.when(F.col("n") < least, "count").when(F.col("_y") < least_y, "north-south").when(F.col("_x") < least_x, "east-west")
    return g.select(key, "n", reason.isNull().alias("passed"), reason.alias("reason"))


def along_track(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """points with along and across: places on the principal axes of their key's points, from its centre. The long axis points east
    (north if it runs north). Points without both places have neither."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    axis = points.groupBy(key).agg(F.avg(px).alias("_cx"), F.avg(py).alias("_cy"), (0.5 * F.atan2(2 * F.covar_pop(px, py), F.var_pop(px) - F.var_pop(py))).alias("_a"))
    dx, dy = px - F.col("_cx"), py - F.col("_cy")
    return points.join(axis, key).withColumns({"along": dx * F.cos("_a") + dy * F.sin("_a"), "across": dy * F.cos("_a") - dx * F.sin("_a")}).drop("_cx", "_cy", "_a")


def mosaic(tiles: DataFrame, keys: list[str], v: str, *order: str) -> DataFrame:
    """The first value that isn't null of each cell, by the given order of tiles; null where no tile has one."""
    return tiles.groupBy(*keys).agg(F.min_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v))


def control_gate(points: DataFrame, site: DataFrame, ground: int = 2, max_speed: float = 10.0, budget: float | None = None, residual: float | None = 100.0) -> DataFrame:
    """points with reason: why one is no control, or null where it is.

    points: (id, fy, fx in cells, h and, for a budget, dt_yr, the years between the point and the height model); site: (iy, ix, mask, speed,
    surface), of which the next cell up is read. In this order: no height, not on `ground`, too fast (moved more than `budget` metres in dt_yr,
    or, without a budget or dt_yr, faster than max_speed a year), too far from the surface (`residual` or more, or unknown).
    """
    at = points.withColumns({"iy": F.ceil("fy").cast("int"), "ix": F.ceil("fx").cast("int")}).join(site.select("iy", "ix", "mask", "speed", "surface"), ["iy", "ix"], "left")
    slow = F.col("speed") < max_speed
    if budget is not None and "dt_yr" in points.columns:
        slow = F.when(F.col("dt_yr").isNotNull(), F.col("speed") * F.abs("dt_yr") <= budget).otherwise(slow)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(F.col("h").isNull() | F.isnan(F.col("h")), "height").when(no(F.col("mask") == ground), "ground").when(no(slow), "speed")
    if residual is not None and residual > 0:
        reason = reason.when(no(F.abs(F.col("h") - F.col("surface")) < residual), "residual")
    return at.select(*[F.col(c) for c in points.columns], reason.alias("reason"))


def best_sigma(sources: Column, sigma: dict[str, float], fallback: float) -> Column:
    """The smallest sigma of the named sources (any case, blanks around); the fallback if none is known."""
    known = F.create_map(*[F.lit(x) for kv in sigma.items() for x in kv])
    return F.coalesce(F.array_min(F.transform(sources, lambda s: F.try_element_at(known, F.lower(F.trim(s))))), F.lit(float(fallback)))


def pass_checks(by_class: DataFrame, by_year: DataFrame, name: str, bias: float, spread: float, drift: float) -> DataFrame:
    """(check, value, passed): bias and spread (median, mad) of the named class, and the largest step between the medians of following years
    of that class. A check without a value fails, but for the drift of fewer than two years."""
    from pyspark.sql.window import Window

    # One row a year, whatever the number of observations.
    steps = by_year.where(F.col("class") == name).select(F.abs(F.col("median") - F.lag("median").over(Window.partitionBy("class").orderBy("year"))).alias("d"))
    one = by_class.where(F.col("class") == name).agg(F.max(F.abs("median")).alias("bias"), F.max("mad").alias("spread"))
    all_three = one.crossJoin(steps.agg(F.max("d").alias("drift")))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.coalesce(F.col(k) <= most, F.lit(k == "drift")).alias("passed")) for k, most in (("bias", bias), ("spread", spread), ("drift", drift))]))
    return all_three.select(rows.alias("r")).select("r.*")
