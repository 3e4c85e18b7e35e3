"""Iterative solvers whose rounds are aggregates: joint trends of cells and planes of epochs, k-means, principal components, a Kalman filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import MAD_TO_SIGMA, TUKEY_C

from .stats import median_of_all


def epoch_offsets(cells: DataFrame, keep, rounds: int = 30, ridge_cell: float = 1e-6, ridge_epoch: float = 1e-3, tol: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Offsets of epochs and trends of cells that fit z (cell, epoch, t, z) together: z = level + slope * t + offset of the epoch.

    The least squares with small ridges are solved directly: cells are eliminated by aggregates, and the system of epochs that is left (epochs
    are few: epochs x epochs numbers reach the driver) is solved and refined until its residual is `tol` of its right side; an error is raised
    if `rounds` refinements don't reach that. The mean offset is 0 at the end. Returns (cell, level, slope) and (epoch, offset).
    """
    spark = cells.sparkSession
    t0 = cells.agg(F.avg("t")).first()[0] or 0.0
    rows = cells.where("z is not null").withColumn("t", F.col("t") - t0)
    base = keep(rows.join(rows.groupBy("cell").agg(F.median("z").alias("_m")), "cell").withColumn("z", F.col("z") - F.col("_m")))
    met = keep(base.groupBy("cell", "epoch").agg(F.count("*").alias("n"), F.sum("t").alias("st"), F.sum("z").alias("sz"), F.sum(F.col("t") * F.col("z")).alias("stz"), F.sum(F.col("t") * F.col("t")).alias("stt")))
    n, stt = F.sum("n") + ridge_cell, F.sum("stt") + ridge_cell
    own = met.groupBy("cell").agg(n.alias("_n"), F.sum("st").alias("_st"), stt.alias("_stt"), F.sum("sz").alias("_sz"), F.sum("stz").alias("_stz"), (n * stt - F.sum("st") * F.sum("st")).alias("_den"))
    # What an epoch's rows of a cell take from the cell's level and slope.
    part = met.join(own, "cell").withColumn("level", (F.col("_stt") * F.col("n") - F.col("_st") * F.col("st")) / F.col("_den")).withColumn("slope", (F.col("_n") * F.col("st") - F.col("_st") * F.col("n")) / F.col("_den"))
    right = part.groupBy("epoch").agg(F.sum("n").alias("n"), F.sum(F.col("sz") - F.col("level") * F.col("_sz") - F.col("slope") * F.col("_stz")).alias("v")).collect()
    pairs = part.select("cell", "epoch", "level", "slope").join(met.select("cell", F.col("epoch").alias("other"), "n", "st"), "cell").groupBy("epoch", "other").agg(F.sum(F.col("level") * F.col("n") + F.col("slope") * F.col("st")).alias("v")).collect()
    at = {r["epoch"]: k for k, r in enumerate(right)}
    system, b = np.diag([r["n"] + ridge_epoch for r in right]).reshape(len(at), len(at)), np.array([r["v"] for r in right], float)
    for r in pairs:
        system[at[r["epoch"]], at[r["other"]]] -= r["v"]
    x = np.linalg.solve(system, b) if at else b
    for _ in range(rounds):
        left = b - system @ x
        if np.abs(left).max(initial=0.0) <= tol * max(np.abs(b).max(initial=0.0), 1e-300):
            break
        x += np.linalg.solve(system, left)
    else:
        raise ArithmeticError(f"the offsets' residual is above {tol} after {rounds} refinements")
    offsets = spark.createDataFrame([(e, float(x[k])) for e, k in at.items()], f"epoch {dict(cells.dtypes)['epoch']}, offset double")
    s = base.join(F.broadcast(offsets), "epoch").withColumn("r", F.col("z") - F.col("offset")).groupBy("cell", "_m").agg(F.count("*").alias("n"), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum("r").alias("sr"), F.sum(F.col("t") * F.col("r")).alias("str"))
    n, stt = F.col("n") + ridge_cell, F.col("stt") + ridge_cell
    den = n * stt - F.col("st") * F.col("st")
    fit = s.select("cell", "_m", ((stt * F.col("sr") - F.col("st") * F.col("str")) / den).alias("level"), ((n * F.col("str") - F.col("st") * F.col("sr")) / den).alias("slope"))
    centre = offsets.agg(F.avg("offset")).first()[0] or 0.0
    return fit.select("cell", (F.col("level") + F.col("_m") + centre - F.col("slope") * t0).alias("level"), "slope"), offsets.withColumn("offset", F.col("offset") - centre)


def tilt_fit(cells: DataFrame, keep, level_sd: float = 10.0, slope_sd: float = 1.0, tilt_sd: tuple[float, float] = (2e-6, 2e-6 / 3), offset_sd: float = 0.1, min_width: float = 0.0, robust: bool = True, rounds: int = 8, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Planes of epochs and trends of cells that fit heights together: z = intercept + dhdt * days + dx (x - xref) + dy (y - yref) + dz.

    cells: (cell, epoch, t in days, x, y, z), one row or none for a cell and epoch. Each unknown has a prior of mean 0 and the given spread,
    levels about the cell's median. Cells are eliminated by aggregates; what is left is a system of three unknowns an epoch (epochs are few:
    nine sums for each pair of them reach the driver), solved directly. robust: Tukey's weights with one scale, until the epochs' unknowns
    move by less than tol of their size. An epoch whose distances from its centre spread less than min_width (5th to 95th percentile) gets an
    offset alone. Returns (epoch, tilt_dx, tilt_dy, tilt_dz, xref, yref, fit_xy, weight_mean, weight_frac_kept) and (cell, intercept, dhdt);
    days count from the mean of the epochs' times.
    """
    spark, c = cells.sparkSession, F.col
    rows = cells.where("z is not null and not isnan(z)")
    refs = rows.groupBy("epoch").agg(F.min("t").alias("te"), F.avg("x").alias("xref"), F.avg("y").alias("yref"))
    off = rows.join(refs, "epoch").groupBy("epoch").agg(F.percentile(F.hypot(c("x") - c("xref"), c("y") - c("yref")), F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    told = refs.join(off, "epoch").select("epoch", "te", "xref", "yref", (c("q")[1] - c("q")[0] > min_width).alias("fit_xy")).orderBy("epoch").collect()
    if not told:
        raise ValueError("no heights")
    epochs, middle = [r["epoch"] for r in told], sum(r["te"] for r in told) / len(told)
    kind = dict(cells.dtypes)["epoch"]
    known = F.broadcast(spark.createDataFrame([(r["epoch"], r["te"] - middle, r["xref"], r["yref"], r["fit_xy"]) for r in told], f"epoch {kind}, tc double, xref double, yref double, fit_xy boolean"))
    lean = lambda at, ref: F.when(c("fit_xy"), c(at) - c(ref)).otherwise(0.0)
    base = rows.join(rows.groupBy("cell").agg(F.median("z").alias("_m")), "cell").join(known, "epoch")
    base = keep(base.select("cell", "epoch", "tc", lean("x", "xref").alias("b0"), lean("y", "yref").alias("b1"), F.lit(1.0).alias("b2"), (c("z") - c("_m")).alias("z"), "_m", F.lit(1.0).alias("w")))
    sd = np.tile([*tilt_sd, offset_sd], len(epochs))
    at = {e: k for k, e in enumerate(epochs)}

    def solve(rows: DataFrame) -> np.ndarray:
        n, st, stt = F.sum("w") + level_sd**-2, F.sum(c("w") * c("tc")), F.sum(c("w") * c("tc") * c("tc")) + slope_sd**-2
        own = rows.groupBy("cell").agg(n.alias("n"), st.alias("st"), stt.alias("stt"), F.sum(c("w") * c("z")).alias("sz"), F.sum(c("w") * c("tc") * c("z")).alias("stz"))
        part = keep(rows.join(own.withColumn("den", c("n") * c("stt") - c("st") * c("st")), "cell"))
        # What a unit of weight at this time takes from the cell's level and slope.
        level, slope = (c("stt") - c("st") * c("tc")) / c("den"), (c("n") * c("tc") - c("st")) / c("den")
        right = part.groupBy("epoch").agg(*[F.sum(c("w") * c(f"b{i}") * (c("z") - level * c("sz") - slope * c("stz"))).alias(f"r{i}") for i in range(3)], *[F.sum(c("w") * c(f"b{i}") * c(f"b{j}")).alias(f"d{i}{j}") for i in range(3) for j in range(3)]).collect()
        other = part.select("cell", c("epoch").alias("other"), c("tc").alias("otc"), c("w").alias("ow"), *[c(f"b{i}").alias(f"o{i}") for i in range(3)])
        shared = c("w") * c("ow") * (level + slope * c("otc"))
        pairs = part.join(other, "cell").groupBy("epoch", "other").agg(*[F.sum(shared * c(f"b{i}") * c(f"o{j}")).alias(f"v{i}{j}") for i in range(3) for j in range(3)]).collect()
        system, b = np.zeros((len(sd), len(sd))), np.zeros(len(sd))
        for r in right:
            k = 3 * at[r["epoch"]]
            b[k : k + 3] = [r[f"r{i}"] for i in range(3)]
            system[k : k + 3, k : k + 3] += [[r[f"d{i}{j}"] for j in range(3)] for i in range(3)]
        for r in pairs:
            k, m = 3 * at[r["epoch"]], 3 * at[r["other"]]
            system[k : k + 3, m : m + 3] -= [[r[f"v{i}{j}"] for j in range(3)] for i in range(3)]
        # Unknowns in units of their priors, which then are an identity.
        return sd * np.linalg.solve(sd[:, None] * system * sd[None, :] + np.eye(len(sd)), sd * b)

    def left(rows: DataFrame, x: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """rows with what the planes leave (r) and what the cells' trends leave of that (e), and the trends."""
        planes = F.broadcast(spark.createDataFrame([(e, *map(float, x[3 * k : 3 * k + 3])) for e, k in at.items()], f"epoch {kind}, p0 double, p1 double, p2 double"))
        r = rows.join(planes, "epoch").withColumn("r", c("z") - c("p0") * c("b0") - c("p1") * c("b1") - c("p2"))
        s = r.groupBy("cell", "_m").agg((F.sum("w") + level_sd**-2).alias("n"), F.sum(c("w") * c("tc")).alias("st"), (F.sum(c("w") * c("tc") * c("tc")) + slope_sd**-2).alias("stt"), F.sum(c("w") * c("r")).alias("sr"), F.sum(c("w") * c("tc") * c("r")).alias("str"))
        den = c("n") * c("stt") - c("st") * c("st")
        trends = s.select("cell", "_m", ((c("stt") * c("sr") - c("st") * c("str")) / den).alias("level"), ((c("n") * c("str") - c("st") * c("sr")) / den).alias("dhdt"))
        return r.join(trends.drop("_m"), "cell").withColumn("e", c("r") - c("level") - c("dhdt") * c("tc")), trends

    x = solve(base)
    for _ in range(rounds if robust else 0):
        e = keep(left(base, x)[0])
        mid = median_of_all(e, "e")
        scale = MAD_TO_SIGMA * median_of_all(e.select(F.abs(c("e") - mid).alias("d")), "d")
        if scale < 1e-9:
            break
        u = c("e") / (TUKEY_C * scale)
        base = keep(e.withColumn("w", F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)).select("cell", "epoch", "tc", "b0", "b1", "b2", "z", "_m", "w"))
        before, x = x, solve(base)
        if np.linalg.norm((x - before) / sd) <= tol * max(np.linalg.norm(before / sd), 1e-12):
            break
    mean = float(x[2::3].mean())  # a shift of all offsets is one of all levels
    weights = {r["epoch"]: (r["m"], r["k"]) for r in base.groupBy("epoch").agg(F.avg("w").alias("m"), F.avg((c("w") > 0).cast("double")).alias("k")).collect()}
    out = spark.createDataFrame([(r["epoch"], float(x[3 * k]), float(x[3 * k + 1]), float(x[3 * k + 2]) - mean, r["xref"], r["yref"], r["fit_xy"], *weights[r["epoch"]]) for k, r in enumerate(told)], f"epoch {kind}, tilt_dx double, tilt_dy double, tilt_dz double, xref double, yref double, fit_xy boolean, weight_mean double, weight_frac_kept double")
    return out, keep(left(base, x)[1].select("cell", (c("level") + c("_m") + mean).alias("intercept"), "dhdt"))


def untilted(cells: DataFrame, epochs: DataFrame) -> DataFrame:
    """cells with z less its epoch's plane."""
    plane = F.col("tilt_dx") * (F.col("x") - F.col("xref")) + F.col("tilt_dy") * (F.col("y") - F.col("yref")) + F.col("tilt_dz")
    return cells.join(F.broadcast(epochs.select("epoch", "tilt_dx", "tilt_dy", "tilt_dz", "xref", "yref")), "epoch").withColumn("z", F.col("z") - plane).select(*cells.columns)


def pair_epoch_bias(pairs: DataFrame, rounds: int = 10, ridge: float = 0.1) -> tuple[float, DataFrame, DataFrame]:
    """Per-epoch biases s behind pair values: value = mu + (s_j - s_i) / dt_yr, robustly.

    pairs: (i, j, dt_yr, value, n), one row for a pair of epochs (they are collected; epochs are few). A row weighs sqrt(min(n, 500)), times
    Tukey's weight of its residual. What
    the model can't tell is fixed: s has mean 0 and no trend over the epochs' numbers; a ridge of that share of the median weight holds epochs
    that few pairs have. Returns mu, (epoch, s) and (i, j, resid, weight).
    """
    spark = pairs.sparkSession
    p = pairs.where("value is not null and dt_yr > 0").select("i", "j", "dt_yr", "value", "n").orderBy("i", "j").toPandas()
    if p.empty:
        raise ValueError("no pairs")
    used = sorted({*p["i"], *p["j"]})
    at, row = {e: k for k, e in enumerate(used)}, np.arange(len(p))
    a = np.zeros((len(p), 1 + len(used)))
    a[:, 0] = 1.0
    np.add.at(a, (row, 1 + p["j"].map(at).to_numpy()), 1 / p["dt_yr"].to_numpy())
    np.add.at(a, (row, 1 + p["i"].map(at).to_numpy()), -1 / p["dt_yr"].to_numpy())
    cell, value = np.sqrt(np.minimum(p["n"].to_numpy(float), 500)), p["value"].to_numpy(float)
    t = np.array(used, float) - np.mean(used)
    t /= max(np.abs(t).max(), 1e-12)
    hard = 1e3 * cell.max() * max(1.0, float(np.abs(a).max()))
    fixed = np.zeros((2 + len(used), a.shape[1]))
    fixed[0, 1:], fixed[1, 1:] = hard, hard * t
    fixed[2:, 1:] = ridge * np.median(cell) * np.eye(len(used))
    w = np.ones(len(p))
    for _ in range(rounds):
        root = cell * w
        x = np.linalg.lstsq(np.vstack([a * root[:, None], fixed]), np.concatenate([value * root, np.zeros(len(fixed))]), rcond=None)[0]
        r = value - a @ x
        scale = MAD_TO_SIGMA * np.median(np.abs(r - np.median(r)))
        if scale < 1e-12:
            break
        new = np.where(np.abs(r) < TUKEY_C * scale, (1 - (r / (TUKEY_C * scale)) ** 2) ** 2, 0.0)
        if np.abs(new - w).max() < 1e-3:
            w = new
            break
        w = new
    biases = spark.createDataFrame([(int(e), float(x[1 + k])) for e, k in at.items()], "epoch long, s double")
    told = spark.createDataFrame([(int(i), int(j), float(e), float(v)) for i, j, e, v in zip(p["i"], p["j"], r, w, strict=True)], "i long, j long, resid double, weight double")
    return float(x[0]), biases, told


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 40, seeds: str = "quantiles") -> DataFrame:
    """(key, cluster): Lloyd's rounds over standardised features until no row changes its cluster (`rounds` at most).

    Centres start at the rows nearest to evenly spaced quantiles along the first principal component (of rows alike the smallest key); or, with
    seeds "farthest", at the row nearest to the mean and then each time at the row farthest from all centres so far (fewer than k where no row
    is off them). A centre that loses all rows stays. A round is one aggregate; centres are k small rows. An empty table gives one.
    """
    one = df.select(vector).first()
    if one is None:
        return df.select(key, F.lit(None).cast("int").alias("cluster"))
    dim = len(one[0])
    each = lambda f: [f(F.get(vector, j).cast("double")) for j in range(dim)]
    mean, sd = (np.array(df.agg(*each(f)).first(), float) for f in (F.avg, F.stddev_pop))
    sd[~(sd > 0)] = 1.0
    lits = lambda v: F.array(*[F.lit(float(x)) for x in v])
    z = df.select(key, F.transform(F.arrays_zip(F.col(vector).alias("x"), lits(mean).alias("m"), lits(sd).alias("s")), lambda e: (e["x"].cast("double") - e["m"]) / e["s"]).alias("_z"))

    def products(batches):
        total, count = np.zeros((dim, dim)), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["_z"].to_numpy()).astype(float)
                total, count = total + x.T @ x, count + len(x)
        yield pd.DataFrame({"v": [total.ravel()], "n": [count]})

    sums = z.select("_z").mapInPandas(products, "v array<double>, n long").collect()
    count = sum(r["n"] for r in sums)
    cov = np.sum([r["v"] for r in sums], axis=0).reshape(dim, dim) / max(count - 1, 1) + 1e-12 * np.eye(dim)
    axis = np.ones(dim) / np.sqrt(dim)
    for _ in range(100):
        axis = cov @ axis
        axis /= max(np.linalg.norm(axis), 1e-30)
    dot = F.aggregate(F.zip_with("_z", lits(axis), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    placed = z.withColumn("_p", dot)
    def distance(c: list[float]):
        return F.aggregate(F.zip_with("_z", lits(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)

    if seeds == "farthest":
        one = placed.agg(F.min(F.struct(distance([0.0] * dim).alias("d"), F.col(key).alias("key"), F.col("_z").alias("z"))).alias("s")).first()["s"]
        centres = [list(one["z"])]
        while len(centres) < k:
            off = F.least(*[distance(c) for c in centres], F.lit(float("inf")))
            far = placed.agg(F.min(F.struct((-off).alias("d"), F.col(key).alias("key"), F.col("_z").alias("z"))).alias("s")).first()["s"]
            if far["d"] >= 0:
                break
            centres.append(list(far["z"]))
    elif seeds == "quantiles":
        quantiles = placed.agg(F.percentile("_p", F.array(*[F.lit((i + 0.5) / k) for i in range(k)]))).first()[0]
        found = placed.agg(*[F.min(F.struct(F.abs(F.col("_p") - F.lit(q)).alias("d"), F.col(key).alias("key"), F.col("_z").alias("z"))).alias(f"s{i}") for i, q in enumerate(quantiles)]).first()
        centres = [list(s["z"]) for s in found]
    else:
        raise ValueError("seeds: quantiles or farthest")

    def nearest(to: list[list[float]]):
        return F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(to)]))["i"]

    before = None
    for _ in range(rounds):
        now = z.withColumn("cluster", nearest(centres)).withColumn("_was", nearest(before) if before else F.lit(-1))
        found = now.groupBy("cluster").agg(F.count_if(F.col("cluster") != F.col("_was")).alias("moved"), *[F.avg(F.get("_z", j)).alias(f"m{j}") for j in range(dim)]).collect()
        last = centres
        if not sum(r["moved"] for r in found):
            break
        means = {r["cluster"]: [r[f"m{j}"] for j in range(dim)] for r in found}
        before, centres = centres, [means.get(i, c) for i, c in enumerate(centres)]
    return z.select(key, nearest(last).alias("cluster"))


def principal_components(df: DataFrame, vector: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of variance and vectors of the first n components, from sums and products added up by partition (dim x dim, whatever the rows).
    Without rows there are none."""
    one = df.select(vector).first()
    if one is None:
        return np.zeros(0), np.zeros((0, 0))
    dim = len(one[0])

    def sums(batches):
        total, outer, count = np.zeros(dim), np.zeros((dim, dim)), 0
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.zeros((0, dim))
            total, outer, count = total + x.sum(0), outer + x.T @ x, count + len(x)
        yield pd.DataFrame({"i": range(dim + 1), "v": [*outer.tolist(), [*total.tolist()]], "n": count})

    parts = df.select(vector).mapInPandas(sums, "i int, v array<double>, n long").groupBy("i").agg(F.array(*[F.sum(F.get("v", j)) for j in range(dim)]).alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    count, mean = parts[0]["n"], np.array(parts[dim]["v"]) / parts[0]["n"]
    cov = np.array([p["v"] for p in parts[:dim]]) / count - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:n]
    return values[order] / values.sum(), vectors[:, order].T


def space_time_modes(cells: DataFrame, n: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """The first n modes of values (cell, epoch, v) about each cell's mean: (epoch, mode, coefficient), (cell, mode, value) and their shares of the
    variance. Cells that lack an epoch are left out.

    Products of epochs are added up by partition (epochs x epochs numbers, whatever the cells); a cell's part of a mode is then its values'
    product with the mode's coefficients. The first cell (by order) with a value other than 0 has a positive one, which fixes the sign.
    """
    spark, kinds = cells.sparkSession, dict(cells.dtypes)
    epochs = [r["epoch"] for r in cells.select("epoch").distinct().orderBy("epoch").collect()]
    if not epochs:
        raise ValueError("no epochs")
    full = cells.where("v is not null").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("epoch", F.col("v").cast("double").alias("v")))).alias("s"))
    full = full.where(F.size("s") == len(epochs)).select("cell", F.transform("s", lambda x: x["v"]).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda x, y: x + y) / len(epochs)
    centred = full.select("cell", mean.alias("m"), "v").select("cell", F.transform("v", lambda x: x - F.col("m")).alias("v"))

    def products(batches):
        total = np.zeros((len(epochs), len(epochs)))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(epochs)), "v": list(total)})

    parts = centred.select("v").mapInPandas(products, "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.get("v", j)) for j in range(len(epochs))]).alias("v")).orderBy("i").collect()
    gram = np.array([r["v"] for r in parts])
    values, vectors = np.linalg.eigh(gram)
    n = min(n, len(epochs) - 1)
    order = np.argsort(values)[::-1][:n]
    size = np.sqrt(np.maximum(values[order], 0.0))
    weights = [[float(w) for w in vectors[:, k] / max(s, 1e-300)] for k, s in zip(order, size, strict=True)]
    part = lambda w: F.aggregate(F.zip_with("v", F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    modes = centred.select("cell", *[part(w).alias(f"m{k}") for k, w in enumerate(weights)])
    first = modes.agg(*[F.min_by(f"m{k}", F.when(F.abs(f"m{k}") > 1e-12, F.col("cell"))).alias(f"m{k}") for k in range(n)]).first() if n else {}
    sign = [-1.0 if (first[f"m{k}"] or 0.0) < 0 else 1.0 for k in range(n)]
    long = modes.select("cell", F.posexplode(F.array(*[F.col(f"m{k}") * sign[k] for k in range(n)])).alias("mode", "value")) if n else modes.select("cell", F.lit(0).alias("mode"), F.lit(0.0).alias("value")).limit(0)
    rows = [(e, k, float(sign[k] * size[k] * vectors[i, order[k]])) for i, e in enumerate(epochs) for k in range(n)]
    total = max(float(np.trace(gram)), 1e-300)
    return spark.createDataFrame(rows, f"epoch {kinds['epoch']}, mode int, coefficient double"), long, [float(v) / total for v in values[order]]


def fused_field(cells: DataFrame, at: list[float], n: int, alpha: float = 1e-3, season: bool = True) -> DataFrame:
    """(cell, t, v, std): a field at the times `at` from epochs (cell, epoch in years, v): each mode's coefficients are smoothed over time and
    put back on the cells' means. std is that of the modes' coefficients, carried to the cells."""
    spark = cells.sparkSession
    coefficients, modes, _ = space_time_modes(cells, n)
    obs = coefficients.select("mode", F.col("epoch").cast("double").alias("t"), F.col("coefficient").alias("v"), F.lit(alpha).alias("alpha"))
    asked = coefficients.select("mode").distinct().crossJoin(F.broadcast(spark.createDataFrame([(float(t),) for t in at], "t double")))
    series = F.broadcast(smooth_series(obs, asked, "mode", season))  # a row for each mode and time
    mean = cells.groupBy("cell").agg(F.avg("v").alias("_m"))
    put = modes.join(series, "mode").groupBy("cell", "t").agg(F.sum(F.col("value") * F.col("mean")).alias("_v"), F.sqrt(F.sum(F.pow(F.col("value") * F.col("std"), F.lit(2.0)))).alias("std"))
    return put.join(mean, "cell").select("cell", "t", (F.col("_m") + F.col("_v")).alias("v"), "std")


def kalman(df: DataFrame, key: str, t: str, v: str, process: float, noise: float) -> DataFrame:
    """A random-walk filter of each key's series in order of time: (key, t, level, variance). A series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        level, var, last, out = None, None, None, []
        for at, x in zip(pdf[t], pdf[v], strict=True):
            if level is None:
                level, var = x, noise
            else:
                var += process * (at - last)
                if x == x:
                    gain = var / (var + noise)
                    level, var = level + gain * (x - level), (1 - gain) * var
            last = at
            out.append((pdf[key].iloc[0], at, level, var))
        return pd.DataFrame(out, columns=[key, t, "level", "variance"])

    return df.select(key, F.col(t).cast("double").alias(t), F.col(v).cast("double").alias(v)).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {t} double, level double, variance double")


def smooth_series(obs: DataFrame, at: DataFrame, key: str, season: bool = True, memory: float = 6.0, floor: float = 0.05) -> DataFrame:
    """(key, t, mean, std) at the times `at` (key, t in years) from a key's values obs (key, t, v, alpha): a level that drifts along a drifting
    slope, with a yearly wave if season, filtered forwards and smoothed backwards.

    alpha: a value's variance over the series'; floor holds its spread up. The slope's drift moves the level by the series' spread within
    `memory` years. A key without values has null results; with one time alone the mean and spread of its values. A series is one group, so its
    length is bounded by a worker's memory.
    """
    kind = dict(obs.dtypes)[key]
    both = obs.select(key, "t", "v", F.coalesce("alpha", F.lit(1e-3)).alias("alpha"), F.lit(False).alias("ask")).unionByName(at.select(key, "t", F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("alpha"), F.lit(True).alias("ask")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = np.unique(pdf.loc[pdf["ask"], "t"].to_numpy(float))
        seen = pdf[~pdf["ask"] & pdf["v"].notna()].sort_values("t", kind="stable")
        v = seen["v"].to_numpy(float)
        frame = lambda mean, std: pd.DataFrame({key: pdf[key].iloc[0], "t": asked, "mean": mean, "std": std})
        if not len(v):
            return frame(np.full(len(asked), None), np.full(len(asked), None))
        spread, times = float(v.std()) or 1.0, np.unique(np.concatenate([asked, seen["t"].to_numpy(float)]))
        if len(times) == 1:
            return frame(v.mean(), spread)
        noise = np.maximum(seen["alpha"].to_numpy(float), floor**2) * spread**2
        size, look = (4, np.array([1.0, 0, 1, 0])) if season else (2, np.array([1.0, 0]))
        drift, waver = spread**2 / max(memory, 0.25) ** 3, (floor * spread) ** 2

        def pass_time(dt: float) -> tuple[np.ndarray, np.ndarray]:
            move, blur = np.eye(size), np.zeros((size, size))
            move[0, 1] = dt
            blur[:2, :2] = drift * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            if season:
                a = 2 * np.pi * dt
                move[2:, 2:] = [[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]
                blur[2:, 2:] = waver * dt * np.eye(2)
            return move, blur

        first = np.searchsorted(seen["t"].to_numpy(float), times, "left")
        last = np.searchsorted(seen["t"].to_numpy(float), times, "right")
        state, cover = np.zeros(size), np.eye(size) * (10 * spread) ** 2
        state[0] = v.mean()
        told, known = [], []
        for k, t in enumerate(times):
            move, blur = pass_time(t - times[k - 1] if k else 0.0)
            state, cover = move @ state, move @ cover @ move.T + blur
            told.append((move, state, cover))
            for j in range(first[k], last[k]):
                gain = cover @ look / (look @ cover @ look + noise[j])
                state, cover = state + gain * (v[j] - look @ state), cover - np.outer(gain, look @ cover)
            known.append((state, cover))
        for k in range(len(times) - 2, -1, -1):
            (move, ahead, ahead_cover), (state, cover) = told[k + 1], known[k]
            back = cover @ move.T @ np.linalg.pinv(ahead_cover)
            known[k] = state + back @ (known[k + 1][0] - ahead), cover + back @ (known[k + 1][1] - ahead_cover) @ back.T
        pick = [known[k] for k in np.searchsorted(times, asked)]
        return frame(np.array([look @ s for s, _ in pick]), np.sqrt([max(look @ c @ look, 0.0) for _, c in pick]))

    return both.groupBy(key).applyInPandas(run, f"{key} {kind}, t double, mean double, std double")
