"""Screens of epochs and cells: filters, HAVING gates, flags with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.functions.scalars import MAD_TO_SIGMA
from cellflow.operators.stats import median_of_all, nmad


def time_window(df: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Rows from start on and before end."""
    return df.where((F.col(t) >= F.lit(start).cast("timestamp_ntz")) & (F.col(t) < F.lit(end).cast("timestamp_ntz")))


def without(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key).distinct(), key, "left_anti")


def static_mask(cells: DataFrame, keys: list[str], z: str, min_count: int, max_std: float) -> DataFrame:
    """Cells that are seen often and vary little (population deviation)."""
    return cells.groupBy(*keys).agg(F.count(z).alias("n"), F.stddev_pop(z).alias("std")).where((F.col("n") >= min_count) & (F.col("std") <= max_std))


def min_extent(cells: DataFrame, floating: DataFrame, keys: list[str], z: str, floor: float = 5.0, min_hits: int = 2, extent: DataFrame | None = None) -> DataFrame:
    """Keys of the floating cells (all rows of floating) that never fall out: below the floor fewer than min_hits times (so that a single
    blunder doesn't count; a cell that was never observed stays), and in extent, the observed coastline's cells, where that is given."""
    hits = cells.where(F.col(z) < floor).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_hits)
    left = floating.select(*keys).distinct().join(hits.select(*keys), keys, "left_anti")
    return left if extent is None else left.join(extent.select(*keys).distinct(), keys, "left_semi")


def bad_epochs(scores: DataFrame, end_limit: float, weight_limit: float) -> DataFrame:
    """Epochs with a large end residual (missing: none) or a low mean weight (missing: bad), worst first."""
    bad = (F.abs(F.coalesce("end_p50", F.lit(0.0))) > end_limit) | (F.coalesce("weight_mean", F.lit(0.0)) < weight_limit)
    return scores.where(bad).orderBy(F.abs(F.coalesce("end_p50", F.lit(0.0))).desc(), F.asc_nulls_last("epoch"))


def epoch_residuals(cells: DataFrame, epochs: DataFrame, trends: DataFrame | None, static: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Scores of epochs, the largest |med_resid| first: (epoch, n_static_obs, med_resid, mad_resid, weight_mean, weight_frac_kept, frac_static).

    cells: (epoch, cell, tc, z), tc in days from the epochs' mean; epochs: (epoch, weight_mean, weight_frac_kept); static: (cell) where the ground
    is still. Residuals are taken to the cell's fit (trends: cell, intercept, dhdt), so that true thinning isn't read as an epoch's error; without
    trends to the cell's median. An epoch without static cells has null residuals. quality: (epoch, end_p50); of several the largest counts.
    """
    total = static.select("cell").distinct().count()
    model = cells.where("z is not null").groupBy("cell").agg(F.median("z").alias("intercept")).withColumn("dhdt", F.lit(0.0)) if trends is None else trends.select("cell", "intercept", "dhdt")
    seen = cells.where("z is not null").join(static.select("cell").distinct(), "cell", "left_semi").join(model, "cell").select("epoch", (F.col("z") - F.col("intercept") - F.col("dhdt") * F.col("tc")).alias("_r")).where("_r is not null")
    score = nmad(seen, ["epoch"], "_r").select("epoch", F.col("n").alias("n_static_obs"), F.col("median").alias("med_resid"), F.col("nmad").alias("mad_resid"))
    out = epochs.select("epoch", "weight_mean", "weight_frac_kept").join(score, "epoch", "left").withColumn("n_static_obs", F.coalesce("n_static_obs", F.lit(0)))
    out = out.withColumn("frac_static", F.col("n_static_obs") / F.lit(total))
    if quality is not None:
        out = out.join(quality.groupBy("epoch").agg(F.max("end_p50").alias("end_p50")), "epoch", "left")
    return out.orderBy(F.abs("med_resid").desc_nulls_last(), "epoch")


def suggest_bad(scores: DataFrame, end_limit: float | None = 10.0, blunder: float | None = 50.0, failed: bool = True, residual: float | None = None, least_static: float = 0.1, least_weight: float = 0.4) -> DataFrame:
    """scores of the epochs to leave out, with reasons, in the order: end_p50 over its limit; a median residual of a blunder; no weight at all; and,
    where `residual` is set, a median residual over it with few static cells or a low weight. A missing end_p50 or residual passes."""
    big = F.abs("med_resid")
    no_weight = F.col("weight_mean").isNull() | F.isnan(F.col("weight_mean"))
    rules = [
        *([F.when(F.col("end_p50") > end_limit, "alignment")] if end_limit is not None and "end_p50" in scores.columns else []), *([F.when(big > blunder, "blunder")] if blunder is not None else []), *([F.when(no_weight, "no fit")] if failed else []),
        *([F.when((big > residual) & ((F.col("frac_static") < least_static) | no_weight | (F.col("weight_mean") < least_weight)), "residual")] if residual is not None else []),
    ]
    return scores.withColumn("reasons", F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")).where(F.size("reasons") > 0)


def screen_unrescued(epochs: DataFrame, variants: list[str], min_n: int, max_offset: float, max_spread: float) -> DataFrame:
    """A flag and its reason for epochs of the listed variants; too few values is tested first."""
    reason = F.when(~F.col("variant").isin(variants), None).when(F.col("n") < min_n, "sparse").when(F.abs("offset") > max_offset, "offset").when(F.col("spread") > max_spread, "wide")
    return epochs.withColumn("reason", reason).withColumn("flagged", F.col("reason").isNotNull())


def cohort_reject(df: DataFrame, id_col: str, values: list[str], k: float = 3.0) -> DataFrame:
    """(id, reason) for each value over its median + k scaled median deviations of all, both found by counts."""
    over = []
    for v in values:
        mid = median_of_all(df, v)
        spread = None if mid is None else median_of_all(df.select(F.abs(F.col(v) - mid).alias("_d")), "_d")
        over.append(F.when(F.col(v) > mid + k * MAD_TO_SIGMA * spread, F.lit(v)) if spread is not None else F.lit(None).cast("string"))
    return df.select(id_col, F.explode(F.array_compact(F.array(*over))).alias("reason"))


def stratify(x: Column, edges: list[float], names: list[str]) -> Column:
    out = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names[:-1], strict=True))):
        out = F.when(x < e, n).otherwise(out)
    return out


def greedy_dedup(pairs: DataFrame, sigma: str = "sigma") -> list[int]:
    """Ids to drop from overlapping pairs (i, j, overlap, sigma_i, sigma_j), taken by falling overlap: the one with the larger sigma goes, j on
    ties and where one is missing. A pair with an id already gone is passed over. Sequential by definition; pairs are those of one stack."""
    gone: set[int] = set()
    for p in pairs.orderBy(F.desc("overlap"), "i", "j").toLocalIterator():
        if p["i"] in gone or p["j"] in gone:
            continue
        si, sj = p[f"{sigma}_i"], p[f"{sigma}_j"]
        gone.add(p["i"] if si is not None and sj is not None and si > sj else p["j"])
    return sorted(gone)
