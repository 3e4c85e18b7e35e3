"""Trends, robust statistics and summaries by group. All are partial aggregates on the group's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import MAD_TO_SIGMA, SECONDS_PER_YEAR, TUKEY_C, guarded_ratio

from .store import keep


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def trend(df: DataFrame, keys: list[str], t: str = "t", z: str = "z", min_count: int = 3) -> DataFrame:
    """Least squares of z on t (seconds) for each group: slope a year, intercept at the first time of all, count, rmse with n - 2 (null to n = 2).

    Times count from the first of all, so large epochs lose no digits. The slope is null where the times don't differ or there
    are fewer than min_count values.
    """
    require_columns(df, *keys, t, z)
    rows = df.where(F.col(z).isNotNull() & F.col(t).isNotNull())
    origin = rows.agg(F.min(t).alias("_t0"))
    at = (F.col(t) - F.col("_t0")) / SECONDS_PER_YEAR
    g = rows.crossJoin(F.broadcast(origin)).withColumn("_y", at).groupBy(*keys).agg(
        F.regr_slope(z, "_y").alias("slope"), F.regr_intercept(z, "_y").alias("intercept"), F.count(z).alias("n"), F.regr_sxx(z, "_y").alias("_sxx"), F.regr_syy(z, "_y").alias("_syy"), F.regr_sxy(z, "_y").alias("_sxy"))
    fits = (F.col("n") >= min_count) & (F.col("_sxx") > 0)
    sse = F.greatest(F.col("_syy") - F.col("_sxy") * guarded_ratio(F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    return g.select(*keys, F.when(fits, F.col("slope")).alias("slope"), F.when(fits, F.col("intercept")).alias("intercept"), "n", F.when(fits & (F.col("n") > 2), F.sqrt(sse / (F.col("n") - 2))).alias("rmse"))


def robust_trend(df: DataFrame, keys: list[str], keep, t: str = "t", z: str = "z", min_count: int = 3, rounds: int = 8, tol: float = 1e-3) -> DataFrame:
    """trend() reweighted by Tukey's biweight with one scale for all groups: the median deviation of absolute residuals about their median.

    Each round is one aggregate by group and one global median, found by counts; keep(df) writes a round's small table of fits so that lineage
    stays short. rmse is that of the last weighted fit over all rows, with n - 2.
    """
    rows = df.where(F.col(z).isNotNull() & F.col(t).isNotNull())
    t0 = rows.agg(F.min(t)).first()[0]
    rows = rows.withColumn("_y", (F.col(t) - F.lit(t0)) / SECONDS_PER_YEAR)
    fit = keep(trend(df, keys, t, z, min_count).where("slope is not null").select(*keys, "slope", "intercept", "n"))
    for _ in range(rounds):
        r = rows.join(fit, keys).withColumn("_r", F.abs(F.col(z) - F.col("intercept") - F.col("slope") * F.col("_y")))
        mid = median_of_all(r, "_r")
        mad = median_of_all(r.select(F.abs(F.col("_r") - F.lit(mid)).alias("_d")), "_d") if mid is not None else None
        if not mad or mad < 1e-9:
            break
        u = F.col("_r") / (TUKEY_C * MAD_TO_SIGMA * mad)
        w = F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0)
        s = r.withColumn("_w", w).groupBy(*keys, "n", F.col("slope").alias("_old")).agg(*[F.sum(F.col("_w") * e).alias(a) for a, e in (("w", F.lit(1.0)), ("wy", F.col("_y")), ("wz", F.col(z)), ("wyy", F.col("_y") * F.col("_y")), ("wyz", F.col("_y") * F.col(z)))])
        den = F.col("w") * F.col("wyy") - F.col("wy") * F.col("wy")
        slope = F.coalesce(guarded_ratio(F.col("w") * F.col("wyz") - F.col("wy") * F.col("wz"), den), F.col("_old"))
        fit = keep(s.withColumn("slope", slope).select(*keys, "slope", F.coalesce(guarded_ratio(F.col("wz") - F.col("slope") * F.col("wy"), F.col("w")), F.lit(0.0)).alias("intercept"), "n", "_old"))
        moved, size = fit.agg(F.max(F.abs(F.col("slope") - F.col("_old"))), F.max(F.abs("slope"))).first()
        fit = fit.drop("_old")
        if moved is None or moved <= tol * size:
            break
    sse = rows.join(fit, keys).groupBy(*keys).agg(F.sum(F.pow(F.col(z) - F.col("intercept") - F.col("slope") * F.col("_y"), F.lit(2.0))).alias("_s"))
    return fit.join(sse, keys).withColumn("rmse", F.when(F.col("n") > 2, F.sqrt(F.col("_s") / (F.col("n") - 2)))).drop("_s")


def nmad(df: DataFrame, keys: list[str], z: str) -> DataFrame:
    """Median, scaled median deviation and count of each group."""
    mid = df.where(F.col(z).isNotNull()).groupBy(*keys).agg(F.median(z).alias("median"), F.count(z).alias("n"))
    dev = df.join(mid, keys).groupBy(*keys, "median", "n").agg((F.median(F.abs(F.col(z) - F.col("median"))) * MAD_TO_SIGMA).alias("nmad"))
    return dev.select(*keys, "n", "median", "nmad")


#: Groups of more rows than this get their medians by counts; a round has so many counters for all groups together.
LARGE, COUNTERS = 100_000, 65_536


def large_medians(rows: DataFrame, keys: list[str], z: str, state: list[dict]) -> list[float]:
    """The exact median of z in each group of state (the keys, n, low and high: rows, least and largest value), found by counts: each round deals a
    group's interval to cells and goes on in the one that holds the median, until it has LARGE values at most, which are then sorted. No task
    holds more than counts or one group's last values."""
    out: list[float | None] = [None] * len(state)
    open_ = {g: ((s["n"] - 1) // 2, s["n"], s["low"], s["high"]) for g, s in enumerate(state)}
    spark, kinds = rows.sparkSession, ", ".join(f"`_k{i}` {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    if not state:
        return []

    def within(open_: dict) -> DataFrame:
        of = [(g, low, high, *[state[g][k] for k in keys]) for g, (_, _, low, high) in open_.items()]
        limits = F.broadcast(spark.createDataFrame(of, f"_g int, _low double, _high double{', ' if keys else ''}{kinds}"))
        own = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        both = rows.select(F.col(z).alias("_v"), *keys)
        return (both.join(limits, own) if own else both.crossJoin(limits)).where(F.col("_v").between(F.col("_low"), F.col("_high"))).select("_g", "_v", "_low", "_high")

    def settle(g: int, a: float, b: float) -> None:
        out[g] = a if state[g]["n"] % 2 else (a + b) / 2
        open_.pop(g, None)

    while True:
        for g, (_, _, low, high) in list(open_.items()):
            if low == high:
                settle(g, low, high)
        wide = {g: o for g, o in open_.items() if o[1] > LARGE}
        if not wide:
            break
        cells = max(16, COUNTERS // len(wide))
        span = F.greatest((F.col("_high") / cells - F.col("_low") / cells), F.lit(5e-324))
        cell = F.least(F.floor((F.col("_v") - F.col("_low")) / span), F.lit(cells - 1)).cast("int")
        counts: dict[int, list] = {}
        for r in within(wide).groupBy("_g", cell.alias("c")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect():
            counts.setdefault(r["_g"], []).append((r["low"], r["high"], r["n"]))
        for g, (k, _, _, _) in wide.items():
            both = sorted(counts[g])
            for i, (low, high, n) in enumerate(both):
                if k < n:
                    break
                k -= n
            if k == n - 1 and state[g]["n"] % 2 == 0:  # the two middle values are in two cells
                settle(g, high, both[i + 1][0])
            else:
                open_[g] = k, n, low, high
    if open_:
        for r in within(open_).groupBy("_g").agg(F.sort_array(F.collect_list("_v")).alias("v")).join(
            F.broadcast(spark.createDataFrame([(g, o[0]) for g, o in open_.items()], "_g int, k int")), "_g").select("_g", F.get("v", F.col("k")).alias("a"), F.coalesce(F.get("v", F.col("k") + 1), F.get("v", F.col("k"))).alias("b")).collect():
            settle(r["_g"], r["a"], r["b"])
    return out


def counted_nmad(rows: DataFrame, keys: list[str], z: str) -> DataFrame:
    """nmad(), for groups of any size: those of more than LARGE rows by counts, whose table the driver holds. Keys may be null; z is a double, whose
    NaN count nowhere as nulls do."""
    full = rows.where(F.col(z).isNotNull() & ~F.isnan(z))
    sizes = full.groupBy(*keys).agg(F.count("*").alias("n"), F.min(z).alias("low"), F.max(z).alias("high"))
    found = sizes.agg(F.count_if(F.col("n") <= LARGE).alias("small"), F.collect_list(F.when(F.col("n") > LARGE, F.struct(*keys, "n", "low", "high"))).alias("large")).first()
    large = [r.asDict() for r in found["large"]]
    mid = large_medians(full, keys, z, large)
    spark, types = rows.sparkSession, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    told = F.broadcast(spark.createDataFrame([(*[s[k] for k in keys], m) for s, m in zip(large, mid, strict=True)], f"{types}, _m double").select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "_m"))
    same = [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)]
    off = full.select(*keys, z).join(told, same).select(*keys, F.abs(F.col(z) - F.col("_m")).alias("_d"))
    reach = [s | {"low": 0.0, "high": max(s["high"] - m, m - s["low"])} for s, m in zip(large, mid, strict=True)]
    spread = large_medians(off, keys, "_d", reach)
    done = spark.createDataFrame([(*[s[k] for k in keys], s["n"], m, d * MAD_TO_SIGMA) for s, m, d in zip(large, mid, spread, strict=True)], f"{types}, n long, median double, nmad double")
    if not found["small"]:
        return done
    small = full.select(*keys, z).join(told, same, "left_anti") if large else full.select(*keys, z)
    value = small.groupBy(*keys).agg(F.collect_list(z).alias("_v")).select(*keys, F.size("_v").cast("long").alias("n"), F.sort_array("_v").alias("_v"))
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    rest = value.withColumn("median", middle(F.col("_v"))).withColumn("_v", F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("median")))))
    return done.unionByName(rest.select(*keys, "n", "median", (middle(F.col("_v")) * MAD_TO_SIGMA).alias("nmad")))


def drop_outliers(df: DataFrame, keys: list[str], z: str, k: float = 3.0, min_count: int = 3) -> DataFrame:
    """Rows within k scaled median deviations of their group's median (all, where that deviation is 0); then groups of min_count rows at least."""
    stat = nmad(df, keys, z).select(*keys, "median", F.col("nmad").alias("_s"))
    good = df.join(stat, keys).where((F.col("_s") == 0) | (F.abs(F.col(z) - F.col("median")) <= k * F.col("_s")))
    enough = good.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select(*keys)
    return good.join(enough, keys, "left_semi").drop("median", "_s")


def summarize(df: DataFrame, keys: list[str | Column], z: str) -> DataFrame:
    """Count, mean, population deviation, median and 16th and 84th percentiles."""
    q = lambda p: F.percentile(z, F.lit(p))
    return df.groupBy(*keys).agg(F.count(z).alias("n"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("std"), F.median(z).alias("median"), q(0.16).alias("p16"), q(0.84).alias("p84"))


def quantiles_of_all(df: DataFrame, z: str, shares: list[float]) -> list[float]:
    """Exact quantiles of a whole column (linear between neighbours), each found by counts as kth() does; empty without values."""
    rows = df.select(F.col(z).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    n, low, high = rows.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    out = []
    for q in shares if n else []:
        at = q * (n - 1)
        a = kth(rows, "_v", int(at), low, high)
        out.append(a if at == int(at) else a + (at - int(at)) * (kth(rows, "_v", int(at) + 1, low, high) - a))
    return out


def quantile_edges(df: DataFrame, z: str, bins: int = 10) -> list[float]:
    """Bin edges at a column's quantiles, without repeats; five equal bins where fewer than two would be left."""
    q = sorted(set(quantiles_of_all(df, z, [k / bins for k in range(bins + 1)])))
    if len(q) > 2 or not q:
        return q or [0.0, 1.0]
    return [q[0] + (q[-1] + 1e-9 - q[0]) * k / 5 for k in range(6)]


def bin_of(v: Column, edges: list[float]) -> Column:
    """The number of v's bin (from 0); bins are half-open but the last, which holds its upper edge. Null outside."""
    inside = v.between(edges[0], edges[-1]) & ~F.isnan(v.cast("double"))
    # A sum of comparisons is compiled, a lambda isn't.
    reached = sum((v >= float(e)).cast("int") for e in edges) if len(edges) <= 64 else F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v))
    return F.when(inside, F.least(reached, F.lit(len(edges) - 1)) - 1)


def nd_binning(df: DataFrame, by: dict[str, list[float]], z: str, min_count: int = 30, statistics: tuple[str, ...] = ("count", "mean", "std", "median", "nmad")) -> DataFrame:
    """Statistics of z in bins of each variable alone and of all together: nd (how many variables), <name>_bin and <name>_mid of each (null
    where a variable doesn't take part), and the statistics. A row outside the edges of any variable, or without z, counts nowhere. nmad is null
    in bins of fewer than min_count rows. by: edges by variable; an empty list takes quantile_edges."""
    by = {v: sorted(set(edges)) if edges else quantile_edges(df, v) for v, edges in by.items()}
    names = list(by)
    binned = df.select(F.col(z).cast("double").alias("_z"), *[bin_of(F.col(v), e).alias(f"_{k}") for k, (v, e) in enumerate(by.items())])
    inside = binned.where(F.col("_z").isNotNull() & ~F.isnan("_z")).dropna(subset=[f"_{k}" for k in range(len(names))])
    inside = keep(inside)  # read again for each round of the medians
    sets = [{k} for k in range(len(names))] + ([set(range(len(names)))] if len(names) > 1 else [])
    # -1: the variable takes no part.
    group = lambda s: F.struct(F.lit(len(s)).alias("nd"), *[(F.col(f"_{k}") if k in s else F.lit(-1)).alias(f"b{k}") for k in range(len(names))])
    rows = inside.select("_z", F.explode(F.array(*[group(s) for s in sets])).alias("g")).select("_z", "g.*")
    keys = ["nd", *[f"b{k}" for k in range(len(names))]]
    every = {"count": F.count("*"), "mean": F.avg("_z"), "std": F.stddev_pop("_z")}
    out = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[every[c].alias(c) for c in statistics if c in every])
    if {"median", "nmad"} & set(statistics):
        robust = counted_nmad(rows, keys, "_z").select(*keys, "median", F.col("nmad").alias("_d"))
        out = out.join(robust, keys).withColumn("nmad", F.when(F.col("_n") >= min_count, F.col("_d")))
    part = lambda k: F.when(F.col(f"b{k}") >= 0, F.col(f"b{k}"))
    middles = lambda e: F.array(*[F.lit((e[i] + e[i + 1]) / 2) for i in range(len(e) - 1)])
    return out.select("nd", *[c for k, v in enumerate(names) for c in (part(k).alias(f"{v}_bin"), F.get(middles(by[v]), part(k)).alias(f"{v}_mid"))], *statistics)


def dispersion_model(binning: DataFrame, by: dict[str, list[float]], statistic: str = "nmad", min_count: int = 30):
    """From nd_binning's rows a function of columns (in the order of by): the statistic, linear between the bins' middles, which hold it
    beyond the outermost. Bins of fewer than min_count rows take the value of the nearest full one (by bins apart; ties to the first).

    The table has a value for each bin and is read by the driver; the function is an expression over it as a literal.
    """
    import itertools
    import math

    names, mids = list(by), [[(a + b) / 2 for a, b in itertools.pairwise(e)] for e in by.values()]
    shape = [len(m) for m in mids]
    if math.prod(shape) > 10_000:
        raise ValueError("more than 10,000 bins")
    full = {tuple(r[f"{v}_bin"] for v in names): r[statistic] for r in binning.where(F.col("nd") == len(names)).where((F.col("count") >= min_count) & F.col(statistic).isNotNull()).collect()}
    if not full:
        raise ValueError("no bin has enough rows")
    place = lambda c: min(full, key=lambda o: (sum((a - b) ** 2 for a, b in zip(c, o, strict=True)), o))
    table = F.array(*[F.lit(float(full[place(c)])) for c in itertools.product(*map(range, shape))])

    def model(*columns: Column) -> Column:
        corner = [(F.lit(0), F.lit(1.0))]
        for c, m in zip(columns, mids, strict=True):
            if len(m) == 1:
                corner = [(at * 1, w) for at, w in corner]
                continue
            v = F.least(F.greatest(c, F.lit(m[0])), F.lit(m[-1]))
            reached = sum((v >= e).cast("int") for e in m) if len(m) <= 64 else F.size(F.filter(F.array(*map(F.lit, m)), lambda e: e <= v))
            k = F.least(reached, F.lit(len(m) - 1)) - 1
            lo, hi = F.get(F.array(*map(F.lit, m)), k), F.get(F.array(*map(F.lit, m)), k + 1)
            u = (v - lo) / (hi - lo)
            corner = [x for at, w in corner for x in ((at * len(m) + k, w * (1 - u)), (at * len(m) + k + 1, w * u))]
        out = F.lit(0.0)
        for at, w in corner:
            out = out + F.get(table, at.cast("int")) * w
        return F.when(F.array_max(F.array(*[c.isNull() for c in columns])), None).otherwise(out)

    return model


def heteroscedasticity(df: DataFrame, by: dict[str, list[float]], z: str, min_count: int = 30) -> tuple[DataFrame, Column, float]:
    """df with sigma, the dispersion that the variables explain, and standard: z over it; both scaled so that standard's scaled median
    deviation is 1. Also the function of the variables as a column, and the scale."""
    by = {v: sorted(set(edges)) if edges else quantile_edges(df, v) for v, edges in by.items()}
    raw = dispersion_model(nd_binning(df, by, z, min_count), by, "nmad", min_count)(*[F.col(v) for v in by])
    first = df.withColumn("_z", F.when(raw > 0, F.col(z) / raw))
    mid = median_of_all(first, "_z")
    mad = median_of_all(first.select(F.abs(F.col("_z") - mid).alias("_d")), "_d") if mid is not None else None
    if not mad:
        raise ValueError("the values don't vary")
    scale = mad * MAD_TO_SIGMA
    return first.withColumns({"sigma": raw * scale, "standard": F.col("_z") / scale}).drop("_z"), raw * scale, scale


def integrate_flux(df: DataFrame, keys: list[str], rate: str, area_km2: float, clip: float = 250.0, quality: Column | None = None) -> DataFrame:
    """Totals of a rate (negative is loss, m a year) over cells of equal area: gigatonnes a year (positive is loss), gt_clip with rates held to
    +-clip, a robust total from the median, mean, median, deepest loss, percentiles, and the share of the largest 5 % of all cells among the
    losing ones. quality: which cells count.

    Nothing is ranked: the 5 % cut is the percentile that holds them, and cells that tie with it count in part, so that a key with a third of
    all cells is partial aggregates.
    """
    gt = 1e6 * area_km2 * 918.0 / 1e12
    rows = df.where(F.col(rate).isNotNull() & ~F.isnan(F.col(rate).cast("double")) & (F.lit(True) if quality is None else F.coalesce(quality, F.lit(False))))
    q = lambda p: F.percentile(rate, F.lit(p))
    loss = lambda c: F.greatest(-F.col(c), F.lit(0.0))
    total = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.count("*") * area_km2).alias("area_km2"), (-F.sum(rate) * gt).alias("gt"), (-F.sum(F.greatest(F.least(F.col(rate), F.lit(clip)), F.lit(-clip))) * gt).alias("gt_clip"),
        (-F.median(rate) * F.count("*") * gt).alias("gt_robust"), F.avg(rate).alias("mean"), F.median(rate).alias("median"), F.min(rate).alias("deepest"), q(0.01).alias("p1"), q(0.99).alias("p99"),
        q(0.05).alias("_q"), F.sum(loss(rate)).alias("_loss"))
    # The percentile holds the top cells or a few more; those beyond leave at the largest value that it holds.
    held = rows.select(*keys, F.col(rate).alias("_v")).join(total.select(*keys, "_q"), keys).where("_v <= _q").groupBy(*keys).agg(F.count("*").alias("_k"), F.sum(loss("_v")).alias("_top"), F.max("_v").alias("_cut"))
    extra = loss("_cut") * (F.col("_k") - F.greatest(F.lit(1), F.floor(F.col("n") * 0.05)))
    return total.join(held, keys).select(*keys, "n", "area_km2", "gt", "gt_clip", "gt_robust", "mean", "median", "deepest", "p1", "p99", guarded_ratio(F.col("_top") - extra, F.col("_loss")).alias("top5_share"))


def plane(df: DataFrame, keys: list[str], x: str, y: str, z: str, min_count: int = 4) -> DataFrame:
    """Per key the least-squares plane z = at_mean + ax (x - xc) + ay (y - yc): keys, n, xc, yc, at_mean, ax, ay, sd, se_ax, se_ay.

    Two aggregates: means, then centred sums, which keeps large coordinates from cancelling. Rows with a null are left out. The plane is
    null with fewer than min_count rows or where the places lie on a line.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    mean = rows.groupBy(*keys).agg(F.avg(x).alias("xc"), F.avg(y).alias("yc"), F.avg(z).alias("at_mean"))
    dx, dy, dz = F.col(x) - F.col("xc"), F.col(y) - F.col("yc"), F.col(z) - F.col("at_mean")
    sums = {"sxx": dx * dx, "syy": dy * dy, "sxy": dx * dy, "sxz": dx * dz, "syz": dy * dz, "szz": dz * dz}
    s = rows.join(mean, keys).groupBy(*keys, "xc", "yc", "at_mean").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    s = s.withColumn("det", F.when((F.col("n") >= min_count) & (det > 1e-12 * F.col("sxx") * F.col("syy")), det))
    s = s.withColumns({"ax": (F.col("syy") * F.col("sxz") - F.col("sxy") * F.col("syz")) / F.col("det"), "ay": (F.col("sxx") * F.col("syz") - F.col("sxy") * F.col("sxz")) / F.col("det")})
    s = s.withColumn("sd", F.sqrt(F.greatest(F.col("szz") - F.col("ax") * F.col("sxz") - F.col("ay") * F.col("syz"), F.col("det") * 0) / (F.col("n") - 3)))
    return s.select(*keys, "n", "xc", "yc", "at_mean", "ax", "ay", "sd", (F.col("sd") * F.sqrt(F.col("syy") / F.col("det"))).alias("se_ax"), (F.col("sd") * F.sqrt(F.col("sxx") / F.col("det"))).alias("se_ay"))


def kth(rows: DataFrame, z: str, k: int, low: float, high: float, cells: int = 1024) -> float:
    """The k-th smallest (from 0) of the values of z in low..high, exactly: each round counts them in at most `cells` intervals and goes on
    in the one that holds it, until one value is left. No task sees more than partial counts."""
    while low < high:
        width = (high - low) / cells or 5e-324
        cell = F.least(F.floor((F.col(z) - low) / width), F.lit(cells - 1))
        for r in rows.where(F.col(z).between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(z).alias("low"), F.max(z).alias("high")).orderBy("c").collect():
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


#: Up to so many values are brought together for a median: one job instead of several, and a bounded group.
FEW = 100_000


def median_of_all(df: DataFrame, z: str) -> float | None:
    """The exact median of a whole column, without bringing more than FEW values together; None without values."""
    rows = df.select(F.col(z).cast("double").alias("_v")).where("_v is not null")
    n, low, high = rows.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if n <= FEW:
        return rows.agg(F.median("_v")).first()[0]
    return (kth(rows, "_v", (n - 1) // 2, low, high) + kth(rows, "_v", n // 2, low, high)) / 2


def ranked(df: DataFrame, z: str, name: str, keep) -> DataFrame:
    """df with the rank of z among all rows (ties share the lowest; null without z). Distinct values are dealt to ranges, which keep writes; a
    range's first rank is the number of rows in the ranges below, and values are counted inside their range alone. The table of ranges is numbered
    in one task."""
    from pyspark.sql.window import Window

    values = df.where(F.col(z).isNotNull()).groupBy(F.col(z).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = keep(values.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = dealt.groupBy("_p").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_least")).select("_p", before(Window.orderBy("_least")).alias("_start"))
    ranks = dealt.withColumn("_k", before(Window.partitionBy("_p").orderBy("_v"))).join(F.broadcast(first), "_p").select("_v", (1 + F.col("_start") + F.col("_k")).alias(name))
    return df.join(ranks, F.col(z) == F.col("_v"), "left").drop("_v")


def standardize(df: DataFrame, strata: list[str], z: str) -> DataFrame:
    """df with standard: z over its stratum's robust spread, then over the robust spread of all those, so that the result's is 1.
    Null where a stratum's spread is 0 or unknown, and everywhere if the spread of all is."""
    spread = nmad(df, strata, z).select(*strata, F.when(F.col("nmad") > 0, F.col("nmad")).alias("_s"))
    first = df.join(spread, strata, "left").withColumn("_z", F.col(z) / F.col("_s"))
    mid = median_of_all(first, "_z")
    scale = median_of_all(first.select(F.abs(F.col("_z") - mid).alias("_d")), "_d") if mid is not None else None
    return first.withColumn("standard", F.col("_z") / (scale * MAD_TO_SIGMA) if scale else F.lit(None).cast("double")).drop("_s", "_z")


def robust_plane(df: DataFrame, keys: list[str], x: str, y: str, z: str, keep, min_count: int = 30, rounds: int = 6) -> DataFrame:
    """Per key a plane as of plane(), by Tukey's weights: keys, n, xc, yc, offset (at xc, yc), ax, ay, sd, se_offset, se_ax, se_ay.

    sd is the residuals' scaled median deviation. Each round is one weighted aggregate and one of medians; keep cuts the lineage. Keys with
    fewer than min_count full rows, or whose places lie on a line, are null but for n. A key whose weights add up to less
    than min_count goes back to equal weights.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    centre = keep(full.groupBy(*keys).agg(F.avg("x").alias("xc"), F.avg("y").alias("yc"), F.count("*").alias("n")))
    rows = keep(full.join(centre.where(F.col("n") >= min_count), keys).select(*keys, (F.col("x") - F.col("xc")).alias("x"), (F.col("y") - F.col("yc")).alias("y"), "z", F.lit(1.0).alias("w")))
    c = F.col
    fit = None
    for _ in range(rounds):
        m = rows.groupBy(*keys).agg(F.sum("w").alias("W"), *[(F.sum(c("w") * c(v))).alias(f"s{v}") for v in "xyz"], *[F.sum(c("w") * c(u) * c(v)).alias(f"s{u}{v}") for u, v in ("xx", "xy", "yy", "xz", "yz")])
        # Weighted sums about the weighted centre; places are already near 0.
        m = m.withColumns({f"c{u}{v}": c(f"s{u}{v}") - c(f"s{u}") * c(f"s{v}") / c("W") for u, v in ("xx", "xy", "yy", "xz", "yz")})
        det = c("cxx") * c("cyy") - c("cxy") * c("cxy")
        m = m.withColumn("det", F.when((c("W") >= min_count / 2) & (det > 1e-12 * c("cxx") * c("cyy")), det))
        m = m.withColumns({"ax": (c("cyy") * c("cxz") - c("cxy") * c("cyz")) / c("det"), "ay": (c("cxx") * c("cyz") - c("cxy") * c("cxz")) / c("det")})
        mx, my = c("sx") / c("W"), c("sy") / c("W")
        m = m.withColumn("offset", c("sz") / c("W") - c("ax") * mx - c("ay") * my)
        spread = (c("cyy") * mx * mx - 2 * c("cxy") * mx * my + c("cxx") * my * my) / c("det")
        m = m.select(*keys, "ax", "ay", "offset", (1 / c("W") + spread).alias("v_offset"), (c("cyy") / c("det")).alias("v_ax"), (c("cxx") / c("det")).alias("v_ay")).where("ax is not null")
        left = rows.join(m, keys).withColumn("r", c("z") - c("offset") - c("ax") * c("x") - c("ay") * c("y"))
        scale = nmad(left, keys, "r").select(*keys, c("nmad").alias("sd"))
        fit = keep(m.join(scale, keys))
        u = c("r") / (TUKEY_C * (c("sd") + 1e-12))
        weighed = left.join(scale, keys).select(*keys, "x", "y", "z", F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0).alias("w"))
        enough = weighed.groupBy(*keys).agg((F.sum("w") >= min_count).alias("_enough"))
        rows = keep(weighed.join(enough, keys).select(*keys, "x", "y", "z", F.when(c("_enough"), c("w")).otherwise(1.0).alias("w")))
    se = lambda v: (c("sd") * F.sqrt(c(f"v_{v}"))).alias(f"se_{v}")
    return centre.join(fit, keys, "left").select(*keys, "n", "xc", "yc", "offset", "ax", "ay", "sd", se("offset"), se("ax"), se("ay"))


def clipped_line(df: DataFrame, keys: list[str], x: str, y: str, min_count: int = 10, clip: float = 5.0) -> DataFrame:
    """Per key a least-squares line, fitted again without the rows whose residual is over `clip` median deviations off the median residual:
    keys, n (rows of the fit), slope, intercept, mad (of the fit's residuals). The first fit stays where fewer than min_count rows are left;
    keys with fewer than that are null but for n. Rows with a null are left out."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def line(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))

    def off(rows: DataFrame, fit: DataFrame) -> tuple[DataFrame, DataFrame]:
        left = rows.join(fit.where("slope is not null").select(*keys, "slope", "intercept"), keys).select(*keys, "x", "y", (F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")).alias("r"))
        return left, nmad(left, keys, "r").select(*keys, F.col("median").alias("_m"), (F.col("nmad") / MAD_TO_SIGMA).alias("mad"))

    first = line(full)
    left, spread = off(full, first)
    kept = left.join(spread, keys).where(F.abs(F.col("r") - F.col("_m")) <= clip * (F.col("mad") + 1e-9)).select(*keys, "x", "y")
    again = line(kept).where(F.col("n") >= min_count)
    _, spread_again = off(kept, again)
    second = again.join(spread_again, keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "slope", "intercept", "mad")])
    both = first.join(spread.select(*keys, "mad"), keys, "left").join(second, keys, "left")
    pick = lambda c: F.when(F.col("n") >= min_count, F.when(F.col("_n").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))).alias(c)
    return both.select(*keys, F.coalesce("_n", "n").alias("n"), pick("slope"), pick("intercept"), pick("mad"))
