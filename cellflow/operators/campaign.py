"""Bookkeeping of campaigns: which strips and epochs take part, what windows of time add up to, how variants and eras differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .footprints import inside
from .stats import counted_nmad, nmad
from .store import keep


def elevation_envelope(surface: DataFrame, pad: float = 100.0) -> DataFrame:
    """(low, high): the range of surface + geoid over all cells that have both, padded; nulls without any."""
    z = F.col("surface") + F.col("geoid")
    return surface.agg((F.min(z) - pad).alias("low"), (F.max(z) + pad).alias("high"))


def within_envelope(cells: DataFrame, key: str, z: str, low: float, high: float, least: int = 100) -> DataFrame:
    """(key, n, median, reason) of each strip: `few` cells, a median `outside` the envelope, or null where it may stay."""
    s = cells.where(F.col(z).isNotNull() & ~F.isnan(F.col(z).cast("double"))).groupBy(key).agg(F.count("*").alias("n"), F.median(z).alias("median"))
    return s.withColumn("reason", F.when(F.col("n") < least, "few").when(~F.col("median").between(low, high), "outside"))


def quality_masked(z: Column, match: Column, bits: Column, keep_match: tuple[int, ...] = (1,), keep_bits: tuple[int, ...] = (0, 2)) -> Column:
    """z where both quality layers allow it, else null; a layer that a strip lacks (null) allows all."""
    allowed = F.coalesce(match.isin(*keep_match), F.lit(True)) & F.coalesce(bits.isin(*keep_bits), F.lit(True))
    return F.when(allowed, z)


def sources_of(strips: DataFrame, sidecars: DataFrame, by_root: Column, fallback: list[str]) -> DataFrame:
    """strips with sources: of the strip's sidecar (dem_id, sources), else its root's, else the fallback. An empty list counts as missing."""
    known = sidecars.where(F.size("sources") > 0).dropDuplicates(["dem_id"]).select("dem_id", F.col("sources").alias("_s"))
    return strips.join(known, "dem_id", "left").withColumn("sources", F.coalesce("_s", F.when(F.size(by_root) > 0, by_root), F.array(*map(F.lit, fallback)))).drop("_s")


def in_window(t: Column, start: str, end: str) -> Column:
    """Whether t lies in the half-open window."""
    return (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))


def window_mean(series: DataFrame, keys: list[str], t: str, v: str, error: str, start: str, end: str, sign: int = 1) -> DataFrame:
    """(keys, mean, mean_error, n) over the window; a key without rows in it has null means and n 0. sign -1 turns what counts loss as positive."""
    there = in_window(F.col(t), start, end)
    value = lambda c: F.avg(F.when(there, F.col(c)))
    return series.groupBy(*keys).agg((value(v) * sign).alias("mean"), value(error).alias("mean_error"), F.count(F.when(there, F.col(v))).alias("n"))


def window_sum(series: DataFrame, keys: list[str], t: str, v: str, start: str, end: str, scale: float = 1.0) -> DataFrame:
    """(keys, total) of the values from start to end, both included, in units of `scale`; keys without one aren't in it."""
    rows = series.where((F.col(t) >= F.lit(start).cast("timestamp_ntz")) & (F.col(t) <= F.lit(end).cast("timestamp_ntz")) & F.col(v).isNotNull())
    return rows.groupBy(*keys).agg((F.sum(v) * scale).alias("total"))


def always_there(ice: DataFrame, keys: list[str], year: str, there: str, start: float, end: float) -> DataFrame:
    """Keys of the cells that were there at each of the archive's epochs from start to end and at the last one at or before start. A cell
    without a row at one of those epochs wasn't there; without such an epoch there is an error."""
    years = ice.select(year).distinct()
    first = years.where(F.col(year) <= start).agg(F.max(year)).first()[0]
    used = years.where(F.col(year).between(start, end) | (F.col(year) == F.lit(first)))
    n = used.count()
    if not n:
        raise ValueError("the archive has no epoch at or before the window")
    seen = ice.join(F.broadcast(used), year).where(F.col(there)).select(*keys, year).distinct()
    return seen.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == n).select(*keys)


def region_stats(values: DataFrame, keys: list[str], v: str) -> DataFrame:
    """(keys, n, mean, median) of the finite values."""
    return values.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"))


def temporal_leverage(cells: DataFrame, keys: list[str], t: str, z: str) -> DataFrame:
    """(keys, n, leverage): the sum of squares of the times with a value about their mean."""
    rows = cells.where(F.col(z).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.var_pop(t) * F.count(t)).alias("leverage"))


def bias_by_class(differences: DataFrame, strip: str, classes: list[str], dh: str) -> DataFrame:
    """(classes, strips, bias, spread): the median over strips of each strip's median difference, and their scaled median deviation."""
    per = differences.where(F.col(dh).isNotNull()).groupBy(strip, *classes).agg(F.median(dh).alias("_m"))
    return nmad(per, classes, "_m").select(*classes, F.col("n").alias("strips"), F.col("median").alias("bias"), F.col("nmad").alias("spread"))


def spread_by_gap(pairs: DataFrame, gap: str, v: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n, median, p16, p84) of pair values by the years between their epochs; bins are half-open, and empty ones are left out."""
    low = F.array(*[F.lit(float(e)) for e in edges])
    k = F.size(F.filter(low, lambda e: e <= F.col(gap))) - 1
    rows = pairs.where((F.col(gap) >= edges[0]) & (F.col(gap) < edges[-1]) & F.col(v).isNotNull()).withColumn("bin", k)
    s = rows.groupBy("bin").agg(F.count("*").alias("n"), F.median(v).alias("median"), F.percentile(v, F.lit(0.16)).alias("p16"), F.percentile(v, F.lit(0.84)).alias("p84"))
    return s.select("bin", F.get(low, F.col("bin")).alias("low"), F.get(low, F.col("bin") + 1).alias("high"), "n", "median", "p16", "p84")


def by_basin(strips: DataFrame, prefixes: dict[str, str], basins: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """strips (dem_id, x, y) with basin: that of the longest prefix of the id, else the first one (by name) whose polygon holds the centre, else null."""
    named = F.lit(None).cast("string")
    for prefix, name in sorted(prefixes.items(), key=lambda p: (len(p[0]), p[0])):
        named = F.when(F.col("dem_id").startswith(prefix), name).otherwise(named)
    placed = F.coalesce(*[F.when(inside(F.col("x"), F.col("y"), ring), name) for name, ring in sorted(basins.items())]) if basins else F.lit(None).cast("string")
    return strips.withColumn("basin", F.coalesce(named, placed))


def fingerprint(cells: DataFrame, epoch: str, z: str) -> DataFrame:
    """One row that tells stacks apart: epochs, first, last, ny, nx, finite, mean and dx2 (the mean squared step to the next cell along x)."""
    from pyspark.sql.window import Window

    ahead = F.lead(z).over(Window.partitionBy(epoch, "iy").orderBy("ix"))
    near = F.lead("ix").over(Window.partitionBy(epoch, "iy").orderBy("ix")) == F.col("ix") + 1
    d = cells.withColumn("_d", F.when(near, ahead - F.col(z)))
    return d.agg(F.count_distinct(epoch).alias("epochs"), F.min(epoch).alias("first"), F.max(epoch).alias("last"), (F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"), F.count(z).alias("finite"), F.avg(z).alias("mean"), F.avg(F.col("_d") * F.col("_d")).alias("dx2"))


def same_fingerprint(a: dict, b: dict, rtol: float = 1e-4) -> list[str]:
    """The fields in which two fingerprints differ."""
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 + rtol * abs(y))
    return [k for k in a if not close(a[k], b.get(k))]


def despiked(series: DataFrame, keys: list[str], v: str, limit: float = 2.5) -> DataFrame:
    """series with v set to its key's mean where it is more than limit deviations (of the population) off it."""
    s = series.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    return series.join(s, keys).withColumn(v, F.when(F.abs(F.col(v) - F.col("_m")) > limit * F.col("_s"), F.col("_m")).otherwise(F.col(v))).drop("_m", "_s")


def add_uncontrolled(stack: DataFrame, strips: DataFrame, z: str, offset: float, variant: str) -> DataFrame:
    """The stack and, moved by a constant and tagged, strips that no control reached; fields that those lack are null."""
    return stack.unionByName(strips.withColumn(z, F.col(z) + offset).withColumn("variant", F.lit(variant)), allowMissingColumns=True)


def strip_variance(planes: DataFrame, value: str, error: str, max_sd: float = 5.0, least: int = 100, floor: float = 0.05, robust: bool = True) -> DataFrame:
    """planes with bucket (unfitted, alignment, low_control, population) and tau2: the variance of value over the population without that of its
    errors, `floor` of it at least. robust: by scaled median deviations and the median squared error. All strips get the population's."""
    known = F.col(value).isNotNull() & F.col(error).isNotNull() & ~F.isnan(F.col(value).cast("double")) & ~F.isnan(F.col(error).cast("double"))
    told = planes.withColumn("bucket", F.when(~known, "unfitted").when(F.col("sd") > max_sd, "alignment").when(F.col("n") < least, "low_control").otherwise("population"))
    pop = told.where("bucket = 'population'").select(F.lit(1).alias("_g"), F.col(value).alias("_v"), (F.col(error) * F.col(error)).alias("_e"))
    if pop.limit(3).count() < 3:
        raise ValueError("fewer than three strips make a population")
    if robust:
        raw = nmad(pop, ["_g"], "_v").select("_g", F.pow(F.col("nmad"), F.lit(2.0)).alias("_r")).join(pop.groupBy("_g").agg(F.median("_e").alias("_c")), "_g")
    else:
        raw = pop.groupBy("_g").agg(F.var_pop("_v").alias("_r"), F.avg("_e").alias("_c"))
    tau = raw.select(F.greatest(F.col("_r") - F.col("_c"), floor * F.col("_r")).alias("tau2"))
    return told.crossJoin(F.broadcast(tau))  # one row


def split_noise(cells: DataFrame, key: str, order: list[str], z: str, parts: int = 4) -> DataFrame:
    """(key, noise): epochs are dealt in turn to parts; the deviation (of the population) of the parts' means over the root of their number."""
    from pyspark.sql.window import Window

    dealt = cells.where(F.col(z).isNotNull()).withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(*order)) % parts)
    means = dealt.groupBy(key, "_p").agg(F.avg(z).alias("_m"))
    return means.groupBy(key).agg(F.when(F.count("*") == parts, F.stddev_pop("_m") / (parts**0.5)).alias("noise"))


def overlapping_strips(index: DataFrame, ring: list[tuple[float, float]], start: str | None = None, end: str | None = None, control: DataFrame | None = None) -> DataFrame:
    """Strips (dem_id, day, x0, y0, x1, y1, valid) that touch the polygon's box and have a corner or the centre in it, or hold one of its
    corners; in the half-open time window; with valid area; and, if control (x0, y0, x1, y1) is given, that touch one of those boxes."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    boxed = (F.col("x0") <= max(xs)) & (F.col("x1") >= min(xs)) & (F.col("y0") <= max(ys)) & (F.col("y1") >= min(ys))
    c = F.col
    spots = [(c("x0"), c("y0")), (c("x0"), c("y1")), (c("x1"), c("y0")), (c("x1"), c("y1")), ((c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2)]
    holds = [(c("x0") <= x) & (c("x1") >= x) & (c("y0") <= y) & (c("y1") >= y) for x, y in ring]
    any_of = lambda conditions: F.array_contains(F.array(*conditions), F.lit(True))
    out = index.where(boxed & any_of([inside(x, y, ring) for x, y in spots] + holds) & (c("valid") > 0))
    if start and end:
        out = out.where(in_window(c("day"), start, end))
    if control is None:
        return out
    from .footprints import overlapping

    width = index.agg(F.max(c("x1") - c("x0")), F.max(c("y1") - c("y0"))).first()
    touched = overlapping(out.select(c("dem_id").alias("id"), "x0", "y0", "x1", "y1"), control.withColumn("id", F.monotonically_increasing_id()).select("id", "x0", "y0", "x1", "y1"), max(1e-9, *[w or 0.0 for w in width])).select(c("a_id").alias("dem_id")).distinct()
    return out.join(touched, "dem_id", "left_semi")


def grown_box(counts: DataFrame, box: tuple[int, int, int, int], target: int, step: int = 1) -> tuple[int, int, int, int]:
    """A box of cells (x0, x1, y0, y1; ends excluded) grown from `box` until it holds `target` of the counts (iy, ix, n): each time by `step` on
    the side that brings most for each cell (ties in the order west, east, north, south), or until no side is left.

    Sums of boxes come from the running sums of all cells (a window along rows, then along columns), read once: a grid's cells reach the driver.
    """
    import numpy as np
    from pyspark.sql.window import Window

    across = F.sum("n").over(Window.partitionBy("iy").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0))
    summed = counts.withColumn("_r", across).withColumn("_s", F.sum("_r").over(Window.partitionBy("ix").orderBy("iy").rowsBetween(Window.unboundedPreceding, 0)))
    rows = summed.select("iy", "ix", "_s").toPandas()
    ny, nx = int(rows["iy"].max()) + 1, int(rows["ix"].max()) + 1
    total = np.zeros((ny + 1, nx + 1))
    total[rows["iy"] + 1, rows["ix"] + 1] = rows["_s"]
    held = lambda b: total[b[3], b[1]] - total[b[2], b[1]] - total[b[3], b[0]] + total[b[2], b[0]]
    area = lambda b: (b[1] - b[0]) * (b[3] - b[2])
    now = box
    while held(now) < target:
        x0, x1, y0, y1 = now
        ways = [(max(0, x0 - step), x1, y0, y1), (x0, min(nx, x1 + step), y0, y1), (x0, x1, max(0, y0 - step), y1), (x0, x1, y0, min(ny, y1 + step))]
        ways = [w for w in ways if w != now]
        if not ways:
            break
        now = max(ways, key=lambda w: (held(w) - held(now)) / (area(w) - area(now)))
    return now


def drop_noise(points: DataFrame, peakiness: float | None = 1.5, quality: int | None = 1) -> DataFrame:
    """Points of a radar with a peaky enough waveform and a good enough retracker; a limit of None lets all pass, a missing value doesn't pass."""
    out = points
    if peakiness is not None:
        out = out.where(F.col("peakiness") > peakiness)
    return out.where(F.col("retracker_quality") >= quality) if quality is not None else out


def agreement_by(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, bias, spread, rmse, r): a less b in the median, its scaled median deviation, root mean square, and their correlation. Medians are found by
    counts over several rounds, for which the columns are written once."""
    rows = keep(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)).withColumn("_d", (F.col(a) - F.col(b)).cast("double"))
    s = counted_nmad(rows, keys, "_d").select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "n", F.col("median").alias("bias"), F.col("nmad").alias("spread"))
    fit = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"), F.corr(a, b).alias("r"))
    return s.join(fit, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]).select(*keys, "n", "bias", "spread", "rmse", "r")
