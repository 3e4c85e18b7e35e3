"""Spatial statistics: variograms of scattered values, models fitted to them, and what they say of the error of a mean."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import MAD_TO_SIGMA

from .store import keep

#: A model's structure: its name, sill and effective range.
Structure = tuple[str, float, float]


def lag_edges(max_lag: float, bins: int = 20) -> list[float]:
    """0 and geometric steps from a five-hundredth of max_lag to max_lag."""
    low = max(max_lag / 500, 1e-6)
    return [0.0, *[low * (max_lag / low) ** (k / (bins - 1)) for k in range(bins - 1)], max_lag]


#: Points of a block at most, pairs that are compared at once, pairs of a task, and values that are brought together for the end of a median.
BLOCK, TILE, TASK, FEW = 8192, 65_536, 250_000_000, 200_000


def met_blocks(points: DataFrame, reach: float | None = None) -> DataFrame:
    """Pairs of blocks of points (id, x, y, v), dealt to tasks of about TASK pairs of points: the arrays id, x, y, v of one as a and of the other as b,
    and whether they are the same block. Every two points less than reach apart (None: any two) are in one row, once.

    Points are hashed into squares of side reach, which meet themselves and four of the eight next ones; squares of more than BLOCK points are split by
    a hash of the id. Which blocks meet is found without their points.
    """
    full = points.where(" and ".join(f"{c} is not null" for c in ("id", "x", "y", "v")))
    square = lambda c: F.floor(F.col(c) / reach) if reach else F.lit(0).cast("long")
    laid = full.select("id", *[F.col(c).cast("double").alias(c) for c in "xyv"], square("x").alias("gx"), square("y").alias("gy"))
    large = laid.groupBy("gx", "gy").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    split = laid.join(F.broadcast(large), ["gx", "gy"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK)), F.lit(0)))
    gathered = split.groupBy("gx", "gy", "part").agg(F.collect_list(F.struct("id", "x", "y", "v")).alias("p"))
    at = F.struct("gx", "gy", "part")
    blocks = keep(gathered.select(at.alias("at"), *[F.col(f"p.{c}").alias(c) for c in ("id", "x", "y", "v")]))
    size = blocks.select("at", F.size("x").cast("long").alias("n"))
    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))[: 5 if reach else 1]]))
    a = size.select(F.col("at").alias("a"), F.col("n").alias("na"), ways.alias("w")).select("a", "na", (F.col("a.gx") + F.col("w.i")).alias("gx"), (F.col("a.gy") + F.col("w.j")).alias("gy"))
    b = size.select(F.col("at").alias("b"), F.col("n").alias("nb"), F.col("at.gx").alias("gx"), F.col("at.gy").alias("gy"))
    own = (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    pairs = keep(a.join(b, ["gx", "gy"]).where(~own | (F.col("a.part") <= F.col("b.part"))).select("a", "b", (F.col("na") * F.col("nb")).alias("n")))
    rows, total = pairs.agg(F.count("*"), F.sum("n")).first()
    for name in "ab":
        pairs = pairs.join(blocks.select(F.col("at").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("id", "x", "y", "v")]), name)
    named = [f"{name}_{c}" for name in "ab" for c in ("id", "x", "y", "v")]
    return pairs.select((F.col("a") == F.col("b")).alias("same"), *named).repartition(max(1, min(rows, math.ceil((total or 0) / TASK))))


def near_pairs(parts, reach: float | None = None):
    """From rows of met_blocks the pairs: arrays of distances (below reach) and of differences of v, TILE pairs or a few more at a time."""
    for df in parts:
        for r in df.itertuples():
            ids, alike = np.asarray(r.b_id), not r.same and bool(set(r.a_id) & set(r.b_id)) or r.same and len(set(r.a_id)) < len(r.a_id)
            step, place = max(1, TILE // len(r.b_x)), np.arange(len(r.b_x))
            for i in range(0, len(r.a_x), step):
                rows = slice(i, i + step)
                dx, dy = r.a_x[rows, None] - r.b_x, r.a_y[rows, None] - r.b_y
                d, dv = np.sqrt(dx * dx + dy * dy), r.a_v[rows, None] - r.b_v
                ok = d < (math.inf if reach is None else reach)
                if r.same:
                    ok &= place[rows, None] < place
                if alike:
                    ok &= np.asarray(r.a_id)[rows, None] != ids
                yield d[ok], dv[ok]


def abs_medians(met: DataFrame, edges: list[float]) -> dict[int, tuple[int, float]]:
    """By bin of distance the number of pairs and the exact median of the differences' sizes, found by counts: a size's bits as a whole number are
    in the order of sizes, and each round counts the next bits of those that share the bits found so far, until few values are left."""
    bounds, bins = np.asarray(edges), len(edges) - 1

    def counts(slots: dict[tuple[int, int], int] | None, before: int, shift: int, cells: int) -> dict[int, dict[int, int]]:
        """By slot (at first: bin) and next bits the number of pairs; slots: of a bin and the bits found, which are those from `before` on."""
        ways = [np.full((2, bins), -1), np.zeros((2, bins), np.int64)]
        for (k, bits), slot in (slots or {}).items():
            way = 0 if ways[0][0, k] < 0 else 1
            ways[0][way, k], ways[1][way, k] = slot, bits
        size, reach = (len(slots) if slots else bins) * cells, edges[-1]

        def of(parts):
            total, some, held = np.zeros(size, np.int64) if cells else {}, [], 0

            def add(keys):
                if cells:
                    np.add(total, np.bincount(keys, minlength=size), out=total)
                else:
                    for k, n in zip(*np.unique(keys, return_counts=True, axis=0), strict=True):
                        total[tuple(k)] = total.get(tuple(k), 0) + int(n)

            for d, dv in near_pairs(parts, reach):
                k, bits = np.searchsorted(bounds, d, "right") - 1, np.abs(dv).view(np.int64)
                if bounds[0] > 0:
                    k, bits = k[inside := k >= 0], bits[inside]
                if slots is None:
                    keys = [k * cells + (bits >> shift)]
                else:
                    keys, high = [], bits >> before
                    for slot, found in zip(*ways, strict=True):
                        hit = np.flatnonzero((high == found[k]) & (slot[k] >= 0))
                        low = bits[hit] - (high[hit] << before)
                        keys.append(slot[k[hit]] * cells + (low >> shift) if cells else np.stack([slot[k[hit]], low], 1))
                some += keys
                held += sum(map(len, keys))
                if held > 1_000_000:
                    add(np.concatenate(some))
                    some, held = [], 0
            if some:
                add(np.concatenate(some))
            if cells:
                at = np.flatnonzero(total)
                yield pd.DataFrame({"slot": at // cells, "cell": at % cells, "n": total[at]})
            else:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["slot", "cell", "n"]).astype("int64")

        out: dict[int, dict[int, int]] = {}
        for r in met.mapInPandas(of, "slot long, cell long, n long").groupBy("slot", "cell").agg(F.sum("n").alias("n")).collect():
            out.setdefault(r["slot"], {})[r["cell"]] = r["n"]
        return out

    before, shift, slots = 63, 48, None
    found = counts(None, before, shift, 1 << (before - shift))
    number = {k: sum(c.values()) for k, c in found.items()}
    # For each bin two ranks: the bits found so far, and the rank among those that share them.
    search = {(k, way): (0, (n - 1 + way) // 2) for k, n in number.items() for way in (0, 1)}
    while search:
        held = {}
        for (k, way), (bits, rank) in search.items():
            for cell, n in sorted(found[k if slots is None else slots[k, bits]].items()):
                if rank < n:
                    break
                rank -= n
            bits = bits << (before - shift) | cell
            search[k, way], held[k, bits] = (bits, rank), n
        if not shift:
            break
        few = sum(held.values()) <= FEW
        before, shift, slots = shift, 0 if few else max(0, shift - 14), {key: i for i, key in enumerate(sorted(held))}
        found = counts(slots, before, shift, 0 if few else 1 << (before - shift))
    value = lambda bits: float(np.array([bits], np.int64).view(np.float64)[0])
    return {k: (n, (value(search[k, 0][0]) + value(search[k, 1][0])) / 2) for k, n in number.items()}


def variogram(points: DataFrame, edges: list[float], estimator: str = "dowd", min_pairs: int = 30) -> DataFrame:
    """(bin, lag, n, gamma) of the pairs of points (id, x, y, v) by distance; bins are half-open, lag is a bin's middle.

    matheron: half the mean squared difference. dowd: half the square of the differences' scaled median, which outliers don't move. All pairs
    count, each once; bins of fewer than min_pairs are left out. Pairs are met in blocks and leave their task as counts and sums alone.
    """
    if estimator not in ("matheron", "dowd"):
        raise ValueError("estimator: matheron or dowd")
    edges = sorted(set(map(float, edges)))
    met, bounds = met_blocks(points, edges[-1]), np.asarray(edges)

    def sums(parts):
        n, total = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1)
        for d, dv in near_pairs(parts, bounds[-1]):
            k = np.searchsorted(bounds, d, "right")
            n += np.bincount(k, minlength=len(n))
            total += np.bincount(k, dv * dv, minlength=len(n))
        yield pd.DataFrame({"bin": np.arange(len(n)) - 1, "n": n, "s": total})

    if estimator == "matheron":
        binned = met.mapInPandas(sums, "bin int, n long, s double").where("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n") / 2).alias("gamma"))
    else:
        rows = [(k, n, (MAD_TO_SIGMA * m) ** 2 / 2) for k, (n, m) in sorted(abs_medians(met, edges).items())]
        binned = points.sparkSession.createDataFrame(rows, "bin int, n long, gamma double")
    middle = F.array(*[F.lit((a + b) / 2) for a, b in itertools.pairwise(edges)])
    return binned.where((F.col("n") > 0) & (F.col("n") >= min_pairs)).select("bin", F.get(middle, F.col("bin")).alias("lag"), "n", "gamma")


def model_value(h: np.ndarray, structures: list[Structure]) -> np.ndarray:
    """The sum of structures at lags h: nugget (beyond lag 0), spherical, exponential or gaussian, whose range is the effective one."""
    h, out = np.asarray(h, float), 0.0
    for name, sill, reach in structures:
        u = h / max(reach, 1e-12)
        shape = {"nugget": lambda: (h > 0).astype(float), "spherical": lambda u=u: np.where(u < 1, 1.5 * u - 0.5 * u**3, 1.0), "exponential": lambda u=u: 1 - np.exp(-3 * u), "gaussian": lambda u=u: 1 - np.exp(-4 * u * u)}
        if name not in shape:
            raise ValueError(f"unknown structure {name}")
        out = out + sill * shape[name]()
    return out


def model_column(h: Column, structures: list[Structure]) -> Column:
    """model_value as a column."""
    out = F.lit(0.0)
    for name, sill, reach in structures:
        u = h / max(reach, 1e-12)
        if name not in ("nugget", "spherical", "exponential", "gaussian"):
            raise ValueError(f"unknown structure {name}")
        shape = F.when(h > 0, 1.0).otherwise(0.0) if name == "nugget" else F.when(u < 1, 1.5 * u - 0.5 * F.pow(u, F.lit(3.0))).otherwise(1.0) if name == "spherical" else 1 - F.exp(-3 * u) if name == "exponential" else 1 - F.exp(-4 * u * u)
        out = out + sill * shape
    return out


def covariance(h: Column, structures: list[Structure]) -> Column:
    """The sum of sills less the model."""
    return sum(s for _, s, _ in structures) - model_column(h, structures)


def fit_model(lags, gamma, counts=None, names: tuple[str, ...] = ("nugget", "spherical", "spherical"), max_range: float | None = None, starts: int = 8, seed: int = 0) -> dict:
    """Sills and ranges of a sum of structures, by least squares with the weight counts / lag^2 of each bin: structures, total_sill, ranges,
    rmse, r2 and n_bins. Bins are few, so this runs on the driver.

    For given ranges the sills are a least squares that is not negative, solved exactly; ranges are searched from several starts by a downhill
    simplex on their logarithms. Ranges stay between 0.001 and five times max_range (the largest lag).
    """
    h, g = np.asarray(lags, float), np.asarray(gamma, float)
    ok = np.isfinite(h) & np.isfinite(g) & (h > 0)
    if ok.sum() < 3:
        raise ValueError(f"{ok.sum()} usable bins; three are needed")
    w = np.sqrt(np.maximum(np.asarray(counts, float)[ok], 1)) / h[ok] if counts is not None else np.ones(ok.sum())
    h, g, w = h[ok], g[ok], w / w.max()
    top = max_range or float(h.max())
    ranged = [k for k, n in enumerate(names) if n != "nugget"]

    def best(logs: np.ndarray) -> tuple[float, list[Structure]]:
        reach = np.zeros(len(names))
        reach[ranged] = np.clip(np.exp(logs), 1e-3, 5 * top)
        a = np.stack([model_value(h, [(n, 1.0, reach[k])]) for k, n in enumerate(names)], 1)
        sill = non_negative(a * w[:, None], g * w)
        return float((((a @ sill - g) * w) ** 2).sum()), [(n, float(sill[k]), float(reach[k])) for k, n in enumerate(names)]

    rng, found = np.random.default_rng(seed), None
    for turn in range(starts if ranged else 1):
        begin = np.log(top * (np.linspace(0.1, 0.6, len(ranged)) if turn == 0 else rng.uniform(0.02, 1.5, len(ranged)))) if ranged else np.zeros(0)
        cost, structures = best(downhill(lambda p: best(p)[0], begin))
        if found is None or cost < found[0]:
            found = cost, structures
    left = model_value(h, found[1]) - g
    spread = ((g - g.mean()) ** 2).sum()
    return {"structures": found[1], "total_sill": sum(s for _, s, _ in found[1]), "ranges": [found[1][k][2] for k in ranged], "rmse": float(np.sqrt((left**2).mean())), "r2": float(1 - (left**2).sum() / spread) if spread > 0 else math.nan, "n_bins": int(len(h))}


def non_negative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least squares without negative unknowns: the best of all choices of unknowns that are not 0 (they are few)."""
    found = float((b**2).sum()), np.zeros(a.shape[1])
    for size in range(1, a.shape[1] + 1):
        for some in itertools.combinations(range(a.shape[1]), size):
            x = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
            cost = float(((a[:, some] @ x - b) ** 2).sum())
            if (x >= 0).all() and cost < found[0]:
                full = np.zeros(a.shape[1])
                full[list(some)] = x
                found = cost, full
    return found[1]


def downhill(f, begin: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The place of a least value near begin, by a simplex that is reflected, stretched and shrunk."""
    if not len(begin):
        return begin
    points = [begin, *[begin + 0.4 * np.eye(len(begin))[k] for k in range(len(begin))]]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= 1e-14 * (abs(values[0]) + 1e-300) and max(np.abs(p - points[0]).max() for p in points) < 1e-9:
            break
        middle = np.mean(points[:-1], axis=0)
        step = lambda t: (p := middle + t * (middle - points[-1]), f(p))  # noqa: B023, E731
        p, v = step(1.0)
        if v < values[0]:
            q, u = step(2.0)
            p, v = (q, u) if u < v else (p, v)
        elif v >= values[-2]:
            p, v = step(0.5 if v < values[-1] else -0.5)
        if v < values[-1]:
            points[-1], values[-1] = p, v
        else:
            points = [points[0], *[points[0] + 0.5 * (x - points[0]) for x in points[1:]]]
            values = [values[0], *[f(x) for x in points[1:]]]
    return points[int(np.argmin(values))]


def effective_samples(points: DataFrame, structures: list[Structure], sample: int | None = 1500, draws: int = 5) -> dict:
    """How many independent samples the places (x, y) are worth for their mean: n_eff, var_mean, total_sill, mean_offdiag_cov, n_points.

    Var(mean) is the total sill over N plus (1 - 1/N) times the mean covariance of two different points, which is taken from `draws` samples of
    `sample` points (by hash; all points where there are no more), or from all pairs, in blocks, if sample is None. So n_eff goes to N for white noise and to 1 for a field that is one value.
    A single point is worth one; without points there is an error.
    """
    full = points.where("x is not null and y is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, total, off = full.count(), sum(s for _, s, _ in structures), []
    if not n:
        raise ValueError("no points")
    if sample is None:
        named = full.select(F.monotonically_increasing_id().alias("id"), "x", "y", F.lit(0.0).alias("v"))

        def sums(parts):
            off = [0.0, 0]
            for d, _ in near_pairs(parts):
                off = [off[0] + float((total - model_value(d, structures)).sum()), off[1] + len(d)]
            yield pd.DataFrame([off], columns=["s", "n"])

        s, pairs = met_blocks(named).mapInPandas(sums, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
        sample, draws, off = 2, 0, [s / pairs] if pairs else []
    if sample < 2:
        raise ValueError("a sample of two points at least")
    for draw in range(0 if off else 1 if sample >= n else draws if n > 1 else 0):
        p = full.orderBy(F.xxhash64("x", "y", F.lit(draw)), "x", "y").limit(sample).toPandas().to_numpy() if n > 1 else None
        if p is not None:
            d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])[np.triu_indices(len(p), 1)]
            off.append(float((total - model_value(d, structures)).mean()))
    mean_off = float(np.mean(off)) if off else 0.0
    var = total / n + (1 - 1 / n) * mean_off
    return {"n_eff": total / var if var > 0 else math.inf, "var_mean": var, "total_sill": total, "mean_offdiag_cov": mean_off, "n_points": n}


def standard_error_of_mean(points: DataFrame, structures: list[Structure], sample: int | None = 1500, draws: int = 5) -> float:
    """Root of the variance of the places' mean under the model."""
    return math.sqrt(effective_samples(points, structures, sample, draws)["var_mean"])


def disc_samples(area: float, reach: float, sill: float, nugget: float = 0.0, steps: int = 2000) -> float:
    """How many independent samples an area is worth under a spherical model: total variance over that of the disc's mean."""
    radius = math.sqrt(area / math.pi)
    total, h = 0.0, radius / steps
    for k in range(steps):
        r = (k + 0.5) * h
        rho = 1 - 1.5 * r / reach + 0.5 * (r / reach) ** 3 if r < reach else 0.0
        total += sill * rho * 2 * math.pi * r * h
    return (nugget + sill) / (total / area) if total else math.inf
