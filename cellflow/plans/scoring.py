"""More queries of the catalog: scores of epochs, control points, rasters, infill, shifts, joint fits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellflow.operators import budget, gates, grid, qc, solvers, spatial, spectral, stats
from cellflow.operators.store import keep, shared_dir
from cellflow.plans.catalog import EV, GRID, POINTS, events, grid_points, places, price_grid, query, rounded, shelf, table
from cellflow.sources import raster

CELLS = f"""{EV}, c AS (SELECT CAST(ts AS DATE) AS epoch, user_id AS cell, avg(value) AS z FROM ev GROUP BY 1, 2)"""
SCORES = f"""{CELLS}, s AS (SELECT user_id AS cell FROM (SELECT user_id, stddev_pop(value) AS d FROM ev GROUP BY 1) WHERE d <= 50), m AS (SELECT cell, median(z) AS m FROM c GROUP BY 1),
r AS (SELECT epoch, z - m AS r FROM c JOIN m USING (cell) WHERE cell IN (SELECT cell FROM s)), q AS (SELECT epoch, count(*) AS n, median(r) AS med, mad(r) * 1.4826 AS mad FROM r GROUP BY 1),
e AS (SELECT epoch, CASE WHEN count(*) % 7 <> 0 THEN avg(1 / (1 + abs(z))) END AS weight_mean, avg(CASE WHEN z > 5 THEN 1.0 ELSE 0 END) AS kept FROM c GROUP BY 1),
f AS (SELECT epoch, coalesce(n, 0) AS n_static_obs, med AS med_resid, mad AS mad_resid, weight_mean, kept AS weight_frac_kept, coalesce(n, 0) / (SELECT count(*) FROM s) AS frac_static FROM e LEFT JOIN q USING (epoch))"""


def _scores(spark, d):
    e = events(spark, d)
    cells = e.groupBy(F.to_date("ts").alias("epoch"), F.col("user_id").alias("cell")).agg(F.avg("value").alias("z")).withColumn("tc", F.lit(0.0))
    epochs = cells.groupBy("epoch").agg(F.when(F.count("*") % 7 != 0, F.avg(1 / (1 + F.abs("z")))).alias("weight_mean"), F.avg(F.when(F.col("z") > 5, 1.0).otherwise(0.0)).alias("weight_frac_kept"))
    static = e.groupBy(F.col("user_id").alias("cell")).agg(F.stddev_pop("value").alias("d")).where("d <= 50")
    return qc.epoch_residuals(cells, epochs, None, static)


@query(f"WITH {SCORES} SELECT epoch, n_static_obs, round(med_resid, 6) AS med_resid, round(mad_resid, 6) AS mad_resid, round(weight_mean, 6) AS weight_mean, round(weight_frac_kept, 6) AS weight_frac_kept, round(frac_static, 6) AS frac_static FROM f")
def epoch_scores(spark, d):
    return rounded(_scores(spark, d), 6, "med_resid", "mad_resid", "weight_mean", "weight_frac_kept", "frac_static")


@query(f"""WITH {SCORES} SELECT epoch, concat_ws('|', CASE WHEN abs(med_resid) > 3 THEN 'blunder' END, CASE WHEN weight_mean IS NULL THEN 'no fit' END, CASE WHEN abs(med_resid) > 1 AND (frac_static < 0.1 OR weight_mean IS NULL OR weight_mean < 0.16) THEN 'residual' END) AS reasons FROM f
 WHERE abs(med_resid) > 3 OR weight_mean IS NULL OR (abs(med_resid) > 1 AND (frac_static < 0.1 OR weight_mean < 0.16))""")
def epochs_to_leave_out(spark, d):
    return qc.suggest_bad(_scores(spark, d), 10.0, 3.0, True, 1.0, 0.1, 0.16).select("epoch", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {GRID}, {POINTS}, h AS (SELECT event_id AS id, value AS h, (event_id % 40) / 10.0 AS dt_yr FROM events),
s AS (SELECT pt.id, h, dt_yr, CASE WHEN g.iy IS NULL THEN NULL WHEN g.ix < 20 THEN 2 ELSE 3 END AS mask, g.v / 5000 AS speed, g.v / 1000 AS surface FROM pt JOIN h USING (id) LEFT JOIN g ON g.iy = CAST(ceil(fy) AS INT) AND g.ix = CAST(ceil(fx) AS INT))
SELECT id, CASE WHEN h IS NULL THEN 'height' WHEN mask IS NULL OR mask <> 2 THEN 'ground' WHEN speed IS NULL OR speed * dt_yr > 12 THEN 'speed' WHEN surface IS NULL OR abs(h - surface) >= 30 THEN 'residual' END AS reason FROM s""")
def control_points(spark, d):
    p = grid_points(spark, d).join(events(spark, d).select(F.col("event_id").alias("id"), F.col("value").alias("h"), ((F.col("event_id") % 40) / 10).alias("dt_yr")), "id")
    site = price_grid(spark, d).select("iy", "ix", F.when(F.col("ix") < 20, 2).otherwise(3).alias("mask"), (F.col("v") / 5000).alias("speed"), (F.col("v") / 1000).alias("surface"))
    return gates.control_gate(p, site, 2, 10.0, 12.0, 30.0).select("id", "reason")


@query(f"""WITH {GRID}, {POINTS}, k AS (SELECT id, least(greatest(fy, 0), 10) AS fy, least(greatest(fx, 0), 49) AS fx FROM pt), q AS (SELECT *, CAST(floor(fy) AS INT) AS y0, CAST(floor(fx) AS INT) AS x0, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM k),
c AS (SELECT id, y0 + a.i AS iy, x0 + b.i AS ix, (CASE a.i WHEN 0 THEN 1 - wy ELSE wy END) * (CASE b.i WHEN 0 THEN 1 - wx ELSE wx END) AS w FROM q, range(2) AS a(i), range(2) AS b(i))
SELECT id, CASE WHEN bool_and(v IS NOT NULL) THEN round(sum(w * v), 4) END AS value FROM c LEFT JOIN g USING (iy, ix) WHERE w > 0 GROUP BY 1""")
def bilinear_clamped(spark, d):
    return rounded(grid.gather_bilinear(grid_points(spark, d), price_grid(spark, d), "v", (11, 50)), 4, "value")


@query(f"WITH {GRID} SELECT iy, ix, 1000 + ix * 250.0 AS x, 5000 - iy * 250.0 AS y, round(v, 6) AS v FROM g WHERE v IS NOT NULL")
def raster_round_trip(spark, d):
    """The grid of prices as GeoTIFF tiles of 16 x 16 cells at most, and back: centres of cells from the files' headers."""
    path = shared_dir(spark)
    path = f"{path if ':' in path else f'file://{path}'}/raster-{uuid.uuid4().hex}"
    written = keep(raster.write_rasters(price_grid(spark, d).withColumn("field", F.lit("price")), path, "field", "v", (1000.0, 5000.0), 250.0, 16))
    cells = raster.read_rasters(spark, written.select("file"))
    # A tile counts its own rows and columns from 0; places are the whole grid's.
    whole = cells.select(F.rint((5000 - F.col("y")) / 250).cast("int").alias("iy"), F.rint((F.col("x") - 1000) / 250).cast("int").alias("ix"), "x", "y", "v")
    return rounded(whole, 6, "v")


@query()
def harmonic_gaps(spark, d):
    """Prices of the grid's even cells, the others filled in."""
    g = price_grid(spark, d).select(F.lit("price").alias("field"), "iy", "ix", F.when((F.col("iy") + F.col("ix")) % 2 == 0, F.col("v")).alias("v"), F.lit(True).alias("inside"))
    return rounded(grid.harmonic_infill(g, "field", "v", "inside"), 4, "v")


@query()
def spectral_divergence(spark, d):
    g = price_grid(spark, d).select(F.lit("price").alias("field"), "iy", "ix", (F.col("v") * 0.2).alias("qx"), (F.col("v") * 0.01).alias("qy"))
    return rounded(spectral.helmholtz_divergence(g, "field", "qx", "qy", 250.0), 6, "divergence")


@query()
def tilted_epochs(spark, d):
    """A plane for each quarter's orders over customers laid out on a square."""
    o = table(spark, d, "orders")
    cells = o.groupBy(F.col("o_custkey").alias("cell"), F.trunc("o_orderdate", "quarter").alias("epoch")).agg(F.avg("o_totalprice").alias("z"))
    side = F.col("cell") % 40
    rows = cells.select("cell", "epoch", F.datediff("epoch", F.lit("1995-01-01")).cast("double").alias("t"), (side * 250.0).alias("x"), (F.floor(F.col("cell") / 40) * -250.0).alias("y"), (F.col("z") / 1e4).alias("z"))
    return rounded(rounded(solvers.tilt_fit(rows, keep, 10.0, 0.01, (1e-4, 1e-4), 1.0, rounds=2)[0], 10, "tilt_dx", "tilt_dy"), 6, "tilt_dz", "weight_mean", "weight_frac_kept", "xref", "yref")


@query()
def standardized_places(spark, d):
    """Embeddings' third values over the spread that the first two explain."""
    p = places(spark, d)
    out, _, _ = stats.heteroscedasticity(p, {"x": [], "y": []}, "v", 3)
    return rounded(out.select("id", "sigma", "standard"), 8, "sigma", "standard")


@query()
def fitted_variogram(spark, d):
    v = spatial.variogram(places(spark, d), spatial.lag_edges(0.3, 12), "matheron", 10).orderBy("lag").collect()  # a row for each bin
    fit = spatial.fit_model([r["lag"] for r in v], [r["gamma"] for r in v], [r["n"] for r in v], ("nugget", "spherical"))
    return rounded(spark.createDataFrame([(n, s, r, fit["rmse"]) for n, s, r in fit["structures"]], "model string, sill double, reach double, rmse double"), 5, "sill", "reach", "rmse")


@query()
def flux_along_paths(spark, d):
    """The whole way: paths between all epochs of the shelf, a cell's median over pairs, cells away from the ground, and the flux of what is left."""
    rates = budget.pair_median(budget.lagrangian(shelf(spark, d), (11, 50), 250.0))
    site = price_grid(spark, d).select("iy", "ix")
    floating = gates.away_from(site, F.col("ix") >= 2, F.col("ix") < 2, 500.0, 250.0)
    area = rates.join(floating, ["iy", "ix"]).withColumn("region", F.when(F.col("iy") < 6, "north").otherwise("south"))
    return rounded(stats.integrate_flux(area, ["region"], "rate", 0.0625, 250.0, F.col("n") >= 5), 5, "gt", "gt_clip", "gt_robust", "mean", "median", "deepest", "p1", "p99", "top5_share")


@query()
def parcel_lines(spark, d):
    """A line along each parcel's path over five epochs of the shelf."""
    s = shelf(spark, d).where("start = 0")
    at = F.sequence(F.lit(0), F.lit(4))
    tiles = s.select(F.lit(0).cast("long").alias("tile"), F.transform(at, lambda k: k * 0.5).alias("times"), F.transform(at, lambda k: F.transform("H0", lambda x: x - 0.35 * k)).alias("H"), "vx", "vy", "div", "a_dot")
    return rounded(budget.parcel_rates(tiles, (11, 50), 250.0), 5, "rate", "span", "rmse", "stderr")


@query(f"""WITH {GRID}, l AS (SELECT iy, ix, CASE WHEN v < 50000 THEN 0 WHEN v < 56000 THEN 1 ELSE 2 END AS bin FROM g WHERE v IS NOT NULL), o AS (SELECT y, x, exp(-(x * x + y * y) / 4.5) AS w FROM range(-2, 3) AS a(y), range(-2, 3) AS b(x)),
s AS (SELECT l.iy + y AS iy, l.ix + x AS ix, bin, sum(w) AS w FROM l, o GROUP BY 1, 2, 3)
SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, bin, round(w / sum(w) OVER (PARTITION BY iy, ix), 8) AS weight FROM s WHERE (iy, ix) IN (SELECT (iy, ix) FROM l)""")
def blended_bins(spark, d):
    """The shares of three classes of price about each cell."""
    g = price_grid(spark, d).where("v is not null").select("iy", "ix", F.when(F.col("v") < 50000, 0).when(F.col("v") < 56000, 1).otherwise(2).alias("bin"))
    return rounded(grid.blended(g, "bin", 1.5, 2), 8, "weight")
