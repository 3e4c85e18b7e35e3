"""More queries of the catalog: gates, masks, merges, waveforms and spectral filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellflow.operators import gates, spectral, stats, waveforms

from .catalog import EV, GRID, events, price_grid, query, rounded, table


@query(f"""WITH {GRID}, s AS (SELECT iy, ix, CASE WHEN ix = 0 THEN (lead(v) OVER x - v) / 250 WHEN ix = 49 THEN (v - lag(v) OVER x) / 250 ELSE (lead(v) OVER x - lag(v) OVER x) / 500 END AS gx,
 -CASE WHEN iy = 0 THEN (lead(v) OVER y - v) / 250 WHEN iy = 10 THEN (v - lag(v) OVER y) / 250 ELSE (lead(v) OVER y - lag(v) OVER y) / 500 END AS gy FROM g WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy)),
a AS (SELECT iy, ix, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, -gy) AS w FROM s) SELECT iy, ix, round(slope, 8) AS slope, round(CASE WHEN w < 0 THEN w + 2 * pi() ELSE w END, 8) AS aspect FROM a""")
def slope_aspect(spark, d):
    return rounded(gates.slope_aspect(price_grid(spark, d), "v", 250.0), 8, "slope", "aspect")


@query(f"WITH {GRID} SELECT iy, ix FROM g WHERE v >= 20000 AND NOT EXISTS (SELECT 1 FROM g s WHERE s.v < 20000 AND sqrt((g.iy - s.iy) ** 2 + (g.ix - s.ix) ** 2) * 250 <= 800)")
def away_from_ground(spark, d):
    return gates.away_from(price_grid(spark, d), F.col("v") >= 20000, F.col("v") < 20000, 800.0, 250.0)


@query(f"""WITH {EV}, o AS (SELECT min(t) AS t0 FROM ev WHERE value IS NOT NULL), r AS (SELECT avg(t) AS mid FROM (SELECT DISTINCT t FROM ev)),
s AS (SELECT user_id, CASE WHEN count(value) >= 3 AND regr_sxx(value, (t - t0) / 31557600) > 0 THEN regr_slope(value, (t - t0) / 31557600) END AS slope, avg(value) AS z, avg(CASE WHEN value IS NOT NULL THEN t - mid END) AS lever FROM ev, o, r GROUP BY 1 HAVING count(value) > 0)
SELECT user_id, round(z - coalesce(slope * lever / 31557600, 0), 5) AS mean FROM s""")
def common_epoch_mean(spark, d):
    e = events(spark, d)
    return rounded(gates.common_epoch_mean(e, stats.trend(e, ["user_id"], "t", "value"), "user_id", "t", "value"), 5, "mean")


@query("SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS epochs FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 0.8 * (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)")
def covered_cells(spark, d):
    return gates.covered(events(spark, d).withColumn("day", F.to_date("ts")), "user_id", "day", "value", 0.8)


@query("""WITH s AS (SELECT user_id, count(value) AS n, max(hour(ts)) - min(hour(ts)) AS y, max(value) - min(value) AS x FROM events GROUP BY 1),
r AS (SELECT user_id, n, CASE WHEN n < 60 THEN 'count' WHEN y < 23 THEN 'north-south' WHEN x < 45 THEN 'east-west' END AS reason FROM s) SELECT user_id, n, reason IS NULL AS passed, reason FROM r""")
def spread_gate(spark, d):
    return gates.spread_gate(events(spark, d).withColumn("hour", F.hour("ts")), "user_id", "value", "hour", 60, 23, 45)


@query("""WITH p AS (SELECT event_id, event_type, value AS x, CAST(hour(ts) AS DOUBLE) + value / 4 AS y FROM events),
a AS (SELECT event_type, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT event_id, round((x - cx) * cos(a) + (y - cy) * sin(a), 6) + 0.0 AS along, round((y - cy) * cos(a) - (x - cx) * sin(a), 6) + 0.0 AS across FROM p JOIN a USING (event_type)""")
def along_track(spark, d):
    p = events(spark, d).select("event_id", "event_type", F.col("value").alias("x"), (F.hour("ts") + F.col("value") / 4).alias("y"))
    return gates.along_track(p, "event_type", "x", "y").select("event_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("along", "across")])


@query("SELECT l_suppkey, l_linenumber, arg_min(v, (l_orderkey, l_partkey)) FILTER (v IS NOT NULL) AS v FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1, 2")
def mosaic_first_valid(spark, d):
    return gates.mosaic(table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))), ["l_suppkey", "l_linenumber"], "v", "l_orderkey", "l_partkey")


@query("""SELECT user_id, CAST(coalesce(min(CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'signup' THEN 0.3 WHEN 'error' THEN 2.0 END), 5.0) AS DOUBLE) AS sigma FROM (SELECT * FROM events WHERE value > 20) GROUP BY 1""")
def best_source_sigma(spark, d):
    s = events(spark, d).where("value > 20").groupBy("user_id").agg(F.collect_set(F.concat(F.lit(" "), F.upper("event_type"))).alias("sources"))
    return s.select("user_id", gates.best_sigma(F.col("sources"), {"purchase": 0.1, "signup": 0.3, "error": 2.0}, 5.0).alias("sigma"))


@query("""WITH c AS (SELECT median(l_quantity) - 25 AS m, mad(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'R'),
y AS (SELECT CAST(year(l_shipdate) AS INT) AS year, median(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), t AS (SELECT max(abs(m - p)) AS d FROM (SELECT m, lag(m) OVER (ORDER BY year) AS p FROM y))
SELECT 'bias' AS "check", round(abs(m), 6) AS value, abs(m) <= 2 AS passed FROM c UNION ALL SELECT 'spread', round(s, 6), s <= 5 FROM c UNION ALL SELECT 'drift', round(d, 6), coalesce(d <= 3000, true) FROM t""")
def pass_checks(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), (F.col("l_quantity") - 25).alias("q"), "l_extendedprice", F.year("l_shipdate").alias("year"))
    by_class = stats.nmad(r, ["class"], "q").select("class", "median", (F.col("nmad") / 1.4826).alias("mad"))
    by_year = r.groupBy("class", "year").agg(F.median("l_extendedprice").alias("median"))
    return rounded(gates.pass_checks(by_class, by_year, "R", 2.0, 5.0, 3000.0), 6, "value")


@query("""WITH p AS (SELECT user_id, CAST(hour(ts) AS DOUBLE) AS x, value AS y FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p GROUP BY 1), r AS (SELECT p.*, y - s * x - i AS r FROM p JOIN f USING (user_id)),
m AS (SELECT user_id, median(r) AS m, mad(r) AS d FROM r GROUP BY 1), k AS (SELECT r.* FROM r JOIN m USING (user_id) WHERE abs(r - m) <= 3 * (d + 1e-9)),
g AS (SELECT user_id, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM k GROUP BY 1 HAVING count(*) >= 10), h AS (SELECT user_id, mad(y - s * x - i) AS d FROM k JOIN g USING (user_id) GROUP BY 1)
SELECT user_id, coalesce(g.n, f.n) AS n, CASE WHEN f.n >= 10 THEN round(coalesce(g.s, f.s), 6) END AS slope, CASE WHEN f.n >= 10 THEN round(coalesce(g.i, f.i), 6) END AS intercept, CASE WHEN f.n >= 10 THEN round(coalesce(h.d, m.d), 6) END AS mad
 FROM f LEFT JOIN m USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN h USING (user_id)""")
def clipped_line(spark, d):
    rows = events(spark, d).select("user_id", F.hour("ts").alias("hour"), "value")
    return rounded(stats.clipped_line(rows, ["user_id"], "hour", "value", 10, 3.0), 6, "slope", "intercept", "mad")


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x, i: abs(CAST(x AS DOUBLE)) + CASE WHEN i > 21 THEN 3.0 ELSE 0.1 END) AS r FROM embeddings),
b AS (SELECT vec_id, len(r) AS n, list_transform(r, lambda x, i: list_sum(r[greatest(i - 1, 1):least(i + 1, len(r))]) / 3) AS w FROM w),
h AS (SELECT *, list_median(w[1:8]) AS m FROM b), f AS (SELECT *, list_avg(list_filter(w[1:8], lambda x: x <= m)) AS noise FROM h),
p AS (SELECT *, list_transform(range(4, least(n - 4, n - 1) + 1), lambda g: {'g': g, 'p': greatest(w[g + 1] - noise, 0) ** 2}) AS p FROM f),
s AS (SELECT *, list_sum(list_transform(p, lambda x: x.p)) AS s2, list_sum(list_transform(p, lambda x: x.p ** 2)) AS s4, list_sum(list_transform(p, lambda x: x.g * x.p)) AS m1 FROM p),
c AS (SELECT vec_id, n, m1 / s2 AS centre, m1 / s2 - s2 * s2 / s4 / 2 AS gate, (sqrt(s4 / s2) + noise) / greatest(noise, 1e-6) AS snr, s2 FROM s),
t AS (SELECT *, CASE WHEN NOT s2 > 0 THEN 'flat' WHEN snr < 0.5 THEN 'low_snr' WHEN gate < 4 OR gate > n - 4 THEN 'peak_oob' ELSE 'ok' END AS status FROM c)
SELECT vec_id, CASE WHEN status = 'ok' THEN round(gate, 6) END AS gate, round(snr, 6) AS snr, round(centre, 6) AS peak, status FROM t""")
def centre_of_echo(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.abs(x.cast("double")) + F.when(i > 20, 3.0).otherwise(0.1)).alias("w"))
    out = w.select("vec_id", waveforms.retrack(F.col("w"), "centroid", waveforms.Limits(early=8, snr=0.5, margin=4)).alias("r"))
    return rounded(out.select("vec_id", "r.gate", "r.snr", "r.peak", "r.status"), 6, "gate", "snr", "peak")


@query()
def retracked(spark, d):
    """Each embedding as an echo: its absolute values on a rising edge."""
    limits = waveforms.Limits(early=8, snr=0.5, margin=4)
    w = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.abs(x.cast("double")) + F.when(i > 20, 3.0).otherwise(0.1)).alias("w"))
    return w.select("vec_id", *[waveforms.retrack(F.col("w"), how, limits).alias(how) for how in waveforms.RETRACKERS]).select("vec_id", *[F.col(f"{how}.{c}").alias(f"{how}_{c}") for how in waveforms.RETRACKERS for c in ("gate", "status")])


@query()
def low_passed(spark, d):
    return spectral.apply_multiplier(price_grid(spark, d).withColumn("field", F.lit("price")), "field", "v", 250.0, spectral.low_pass(500.0))
