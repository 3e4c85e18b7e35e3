"""More queries of the catalog: strips, windows, eras and variants, over orders, lines, events and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellflow.operators import campaign as C
from cellflow.plans.catalog import EV, GRID, events, price_grid, query, rounded, table

RING = [(2000.0, 1.0), (9000.0, 5.0), (6000.0, 22.0), (1000.0, 18.0)]
_EDGES = ", ".join(f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(RING, RING[1:] + RING[:1], strict=True))


@query("""WITH e AS (SELECT min(p_retailprice + p_size) - 10 AS low, max(p_retailprice + p_size) + 10 AS high FROM part)
SELECT l_suppkey, count(*) AS n, round(median(l_extendedprice / 55), 6) AS median, CASE WHEN count(*) < 30 THEN 'few' WHEN NOT median(l_extendedprice / 55) BETWEEN any_value(low) AND any_value(high) THEN 'outside' END AS reason FROM lineitem, e GROUP BY 1""")
def strips_in_envelope(spark, d):
    low, high = C.elevation_envelope(table(spark, d, "part").select(F.col("p_retailprice").alias("surface"), F.col("p_size").alias("geoid")), 10.0).first()
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 55).alias("z"))
    return rounded(C.within_envelope(rows, "l_suppkey", "z", low, high, 30), 6, "median")


@query("""SELECT l_returnflag, count(CASE WHEN coalesce(l_linenumber IN (1, 2), true) AND coalesce(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) % 4 END IN (0, 2), true) THEN l_extendedprice END) AS kept,
 round(sum(CASE WHEN coalesce(l_linenumber IN (1, 2), true) AND coalesce(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) % 4 END IN (0, 2), true) THEN l_extendedprice END), 2) AS total FROM lineitem GROUP BY 1""")
def quality_masked(spark, d):
    z = C.quality_masked(F.col("l_extendedprice"), F.col("l_linenumber"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("int") % 4), (1, 2))
    return rounded(table(spark, d, "lineitem").withColumn("z", z).groupBy("l_returnflag").agg(F.count("z").alias("kept"), F.sum("z").alias("total")), 2, "total")


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT o_orderkey, array_to_string(coalesce(s.s, CASE WHEN o_orderstatus = 'F' THEN ['root'] END, ['rock', 'laser']), '+') AS sources FROM orders LEFT JOIN s ON s.id = o_orderkey""")
def sources_of_strips(spark, d):
    side = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("dem_id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("sources"))
    strips = table(spark, d, "orders").select(F.col("o_orderkey").alias("dem_id"), "o_orderstatus")
    out = C.sources_of(strips, side, F.when(F.col("o_orderstatus") == "F", F.array(F.lit("root"))), ["rock", "laser"])
    return out.select(F.col("dem_id").alias("o_orderkey"), F.array_join("sources", "+").alias("sources"))


@query("""SELECT l_suppkey, round(-avg(l_extendedprice) FILTER (l_shipdate >= '1996-01-01' AND l_shipdate < '1996-04-01'), 6) AS mean, round(avg(l_tax) FILTER (l_shipdate >= '1996-01-01' AND l_shipdate < '1996-04-01'), 6) AS mean_error,
 count(*) FILTER (l_shipdate >= '1996-01-01' AND l_shipdate < '1996-04-01') AS n FROM lineitem GROUP BY 1""")
def mean_over_window(spark, d):
    return rounded(rounded(C.window_mean(table(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate", "l_extendedprice", "l_tax", "1996-01-01", "1996-04-01", -1), 6, "mean"), 6, "mean_error")


@query("SELECT l_partkey, round(sum(l_quantity) * 0.001, 6) AS total FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate <= '1995-12-31' GROUP BY 1")
def sum_over_window(spark, d):
    return rounded(C.window_sum(table(spark, d, "lineitem"), ["l_partkey"], "l_shipdate", "l_quantity", "1995-01-01", "1995-12-31", 0.001), 6, "total")


@query("""WITH i AS (SELECT DISTINCT l_suppkey, year(l_shipdate) AS y, l_quantity > 49 AS there FROM lineitem), y AS (SELECT DISTINCT y FROM i), u AS (SELECT y FROM y WHERE y BETWEEN 1995.5 AND 1998 OR y = (SELECT max(y) FROM y WHERE y <= 1995.5))
SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey, y FROM i JOIN u USING (y) WHERE there) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM u)""")
def always_there(spark, d):
    ice = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("double").alias("y"), (F.col("l_quantity") > 49).alias("there"))
    return C.always_there(ice, ["l_suppkey"], "y", "there", 1995.5, 1998.0)


@query("SELECT o_orderstatus, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1, 2")
def region_stats(spark, d):
    return rounded(C.region_stats(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "year"], "o_totalprice"), 6, "mean", "median")


@query(f"WITH {EV} SELECT user_id, count(value) AS n, round(var_pop(t / 86400) * count(value), 4) AS leverage FROM ev WHERE value IS NOT NULL GROUP BY 1")
def temporal_leverage(spark, d):
    return rounded(C.temporal_leverage(events(spark, d).withColumn("days", F.col("t") / 86400), ["user_id"], "days", "value"), 4, "leverage")


@query("""WITH p AS (SELECT l_suppkey, l_linestatus, year(l_shipdate) // 3 AS era, median(l_extendedprice - 30000) AS m FROM lineitem GROUP BY ALL)
SELECT l_linestatus, CAST(era AS INT) AS era, count(*) AS strips, round(median(m), 5) AS bias, round(mad(m) * 1.4826, 5) AS spread FROM p GROUP BY 1, 2""")
def bias_by_era(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", F.floor(F.year("l_shipdate") / 3).cast("int").alias("era"), (F.col("l_extendedprice") - 30000).alias("dh"))
    return rounded(C.bias_by_class(rows, "l_suppkey", ["l_linestatus", "era"], "dh"), 5, "bias", "spread")


@query("""WITH p AS (SELECT date_diff('day', o_orderdate, CAST(l_shipdate AS TIMESTAMP)) / 365.25 AS g, l_extendedprice AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT CAST(CASE WHEN g < 0.5 THEN 0 WHEN g < 2 THEN 1 ELSE 2 END AS INT) AS bin, min(CASE WHEN g < 0.5 THEN 0.0 WHEN g < 2 THEN 0.5 ELSE 2.0 END)::DOUBLE AS low, min(CASE WHEN g < 0.5 THEN 0.5 WHEN g < 2 THEN 2.0 ELSE 5.0 END)::DOUBLE AS high, count(*) AS n,
 round(median(v), 4) AS median, round(quantile_cont(v, 0.16), 4) AS p16, round(quantile_cont(v, 0.84), 4) AS p84 FROM p WHERE g >= 0 AND g < 5 GROUP BY 1""")
def spread_by_gap(spark, d):
    p = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.datediff("l_shipdate", "o_orderdate") / 365.25).alias("g"), F.col("l_extendedprice").alias("v"))
    return rounded(C.spread_by_gap(p, "g", "v", [0.0, 0.5, 2.0, 5.0]), 4, "median", "p16", "p84")


@query(f"""WITH e(x0, y0, x1, y1) AS (VALUES {_EDGES}), s AS (SELECT s_suppkey, s_name AS dem_id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) + 0.5 AS y FROM supplier),
i AS (SELECT s_suppkey, count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0) % 2 = 1 AS inside FROM s, e GROUP BY 1)
SELECT s_suppkey, CASE WHEN starts_with(dem_id, 'Supplier#00000001') THEN 'east' WHEN starts_with(dem_id, 'Supplier#0000000') THEN 'north' WHEN inside THEN 'shelf' END AS basin FROM s JOIN i USING (s_suppkey)""")
def strips_by_basin(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("dem_id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") + 0.5).alias("y"))
    return C.by_basin(s, {"Supplier#0000000": "north", "Supplier#00000001": "east"}, {"shelf": RING}).select("s_suppkey", "basin")


@query("""WITH c AS (SELECT year(l_shipdate) AS epoch, CAST(round_even(l_discount * 100, 0) AS INT) AS iy, CAST(l_quantity - 1 AS INT) AS ix, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT *, CASE WHEN lead(ix) OVER w = ix + 1 THEN lead(z) OVER w - z END AS d FROM c WINDOW w AS (PARTITION BY epoch, iy ORDER BY ix))
SELECT count(DISTINCT epoch) AS epochs, CAST(min(epoch) AS INT) AS first, CAST(max(epoch) AS INT) AS last, max(iy) + 1 AS ny, max(ix) + 1 AS nx, count(z) AS finite, round(avg(z), 4) AS mean, round(avg(d * d), 0) AS dx2 FROM d""")
def stack_fingerprint(spark, d):
    cells = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("epoch"), F.rint(F.col("l_discount") * 100).cast("int").alias("iy"), (F.col("l_quantity") - 1).cast("int").alias("ix")).agg(F.avg("l_extendedprice").alias("z"))
    return rounded(rounded(C.fingerprint(cells, "epoch", "z"), 4, "mean"), 0, "dx2")


@query("""WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN abs(value - m) > 2.5 * s THEN m ELSE value END, 6) AS value FROM events JOIN s USING (user_id)""")
def despiked(spark, d):
    return rounded(C.despiked(events(spark, d).select("event_id", "user_id", "value"), ["user_id"], "value"), 6, "value").select("event_id", "value")


@query("""SELECT o_orderkey, o_totalprice AS z, o_orderpriority AS grade, 'control' AS variant FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_totalprice - 12.5, NULL, 'none' FROM orders WHERE o_orderstatus = 'P'""")
def with_uncontrolled(spark, d):
    o = table(spark, d, "orders").withColumn("z", F.col("o_totalprice"))
    stack = o.where("o_orderstatus <> 'P'").select("o_orderkey", "z", F.col("o_orderpriority").alias("grade"), F.lit("control").alias("variant"))
    return C.add_uncontrolled(stack, o.where("o_orderstatus = 'P'").select("o_orderkey", "z"), "z", -12.5, "none")


@query("""WITH p AS (SELECT user_id, CASE WHEN user_id % 11 <> 0 THEN regr_slope(value, hour(ts)) END AS ax, 0.01 + 0.001 * (user_id % 7) AS se, stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT *, CASE WHEN ax IS NULL THEN 'unfitted' WHEN sd > 55 THEN 'alignment' WHEN n < 55 THEN 'low_control' ELSE 'population' END AS bucket FROM p),
t AS (SELECT (mad(ax) * 1.4826) ** 2 AS r, median(se * se) AS c FROM b WHERE bucket = 'population') SELECT user_id, bucket, round(greatest(r - c, 0.05 * r), 8) AS tau2 FROM b, t""")
def strip_variance(spark, d):
    p = events(spark, d).withColumn("h", F.hour("ts")).groupBy("user_id").agg(F.when(F.col("user_id") % 11 != 0, F.regr_slope("value", "h")).alias("ax"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    p = p.withColumn("se", 0.01 + 0.001 * (F.col("user_id") % 7))
    return rounded(C.strip_variance(p, "ax", "se", 55.0, 55).select("user_id", "bucket", "tau2"), 8, "tau2")


@query("""WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 4 AS p FROM events WHERE value IS NOT NULL), m AS (SELECT user_id, p, avg(value) AS m FROM k GROUP BY 1, 2)
SELECT user_id, CASE WHEN count(*) = 4 THEN round(stddev_pop(m) / 2, 6) END AS noise FROM m GROUP BY 1""")
def quarter_split_noise(spark, d):
    return rounded(C.split_noise(events(spark, d), "user_id", ["ts", "event_id"], "value", 4), 6, "noise")


@query(f"""WITH e(x0, y0, x1, y1) AS (VALUES {_EDGES}), v(px, py) AS (VALUES {", ".join(str(p) for p in RING)}),
s AS (SELECT o_orderkey AS dem_id, o_orderdate AS day, o_totalprice / 50 AS x0, CAST(day(o_orderdate) AS DOUBLE) AS y0, o_totalprice / 50 + 400 AS x1, day(o_orderdate) + 3.0 AS y1, o_orderkey % 9 AS valid FROM orders),
q AS (SELECT dem_id, unnest([x0, x0, x1, x1, (x0 + x1) / 2]) AS x, unnest([y0, y1, y0, y1, (y0 + y1) / 2]) AS y, generate_subscripts([1, 2, 3, 4, 5], 1) AS k FROM s),
i AS (SELECT dem_id, k, count(*) FILTER ((e.y0 > y) <> (e.y1 > y) AND x < (y - e.y0) * ((e.x1 - e.x0) / (e.y1 - e.y0)) + e.x0) % 2 = 1 AS inside FROM q, e GROUP BY 1, 2)
SELECT dem_id FROM s WHERE valid > 0 AND day >= '1993-01-01' AND day < '1996-01-01' AND (dem_id IN (SELECT dem_id FROM i WHERE inside) OR EXISTS (SELECT 1 FROM v WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1))
 AND EXISTS (SELECT 1 FROM supplier c WHERE c.s_acctbal <= x1 AND c.s_acctbal + 200 >= x0 AND c.s_nationkey <= y1 AND c.s_nationkey + 2 >= y0)""")
def strips_over_area(spark, d):
    o = table(spark, d, "orders")
    index = o.select(F.col("o_orderkey").alias("dem_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("day"), (F.col("o_totalprice") / 50).alias("x0"), F.dayofmonth("o_orderdate").cast("double").alias("y0"), (F.col("o_totalprice") / 50 + 400).alias("x1"), (F.dayofmonth("o_orderdate") + 3.0).alias("y1"), (F.col("o_orderkey") % 9).alias("valid"))
    control = table(spark, d, "supplier").select(F.col("s_acctbal").alias("x0"), F.col("s_nationkey").cast("double").alias("y0"), (F.col("s_acctbal") + 200).alias("x1"), (F.col("s_nationkey") + 2.0).alias("y1"))
    return C.overlapping_strips(index, RING, "1993-01-01", "1996-01-01", control).select("dem_id")


@query(f"""WITH RECURSIVE {GRID}, c AS (SELECT iy, ix, CASE WHEN v > 54000 THEN 1 ELSE 0 END AS n FROM g),
w(k, x0, x1, y0, y1) AS (SELECT 0, 20, 25, 4, 6 UNION ALL SELECT k + 1, b.x0, b.x1, b.y0, b.y1 FROM (
 SELECT w.k, o.*, row_number() OVER (ORDER BY o.more / o.cells DESC, o.side) AS r FROM w, LATERAL (SELECT count(*) FILTER (true) AS z, coalesce(sum(n), 0) AS held FROM c WHERE ix >= w.x0 AND ix < w.x1 AND iy >= w.y0 AND iy < w.y1) h,
 LATERAL (SELECT side, a.x0, a.x1, a.y0, a.y1, ((a.x1 - a.x0) * (a.y1 - a.y0) - (w.x1 - w.x0) * (w.y1 - w.y0)) AS cells, (SELECT coalesce(sum(n), 0) FROM c WHERE ix >= a.x0 AND ix < a.x1 AND iy >= a.y0 AND iy < a.y1) - h.held AS more
  FROM (SELECT 1 AS side, greatest(0, w.x0 - 1) AS x0, w.x1 AS x1, w.y0 AS y0, w.y1 AS y1 UNION ALL SELECT 2, w.x0, least(50, w.x1 + 1), w.y0, w.y1 UNION ALL SELECT 3, w.x0, w.x1, greatest(0, w.y0 - 1), w.y1 UNION ALL SELECT 4, w.x0, w.x1, w.y0, least(11, w.y1 + 1)) a
  WHERE a.x0 <> w.x0 OR a.x1 <> w.x1 OR a.y0 <> w.y0 OR a.y1 <> w.y1) o WHERE h.held < 100) b WHERE b.r = 1)
SELECT x0, x1, y0, y1 FROM w WHERE k = (SELECT max(k) FROM w)""")
def grown_box(spark, d):
    counts = price_grid(spark, d).select("iy", "ix", F.when(F.col("v") > 54000, 1).otherwise(0).alias("n"))
    return spark.createDataFrame([C.grown_box(counts, (20, 25, 4, 6), 100)], "x0 int, x1 int, y0 int, y1 int")


@query("SELECT event_id, value FROM events WHERE value / 20 > 1.5 AND user_id % 3 >= 1")
def peaky_points(spark, d):
    p = events(spark, d).withColumn("peakiness", F.col("value") / 20).withColumn("retracker_quality", F.col("user_id") % 3)
    return C.drop_noise(p).select("event_id", "value")


@query("""WITH p AS (SELECT l_returnflag, l_extendedprice / l_quantity AS a, p_retailprice AS b FROM lineitem JOIN part ON p_partkey = l_partkey), d AS (SELECT *, a - b AS d FROM p)
SELECT l_returnflag, count(*) AS n, round(median(d), 5) AS bias, round(mad(d) * 1.4826, 5) AS spread, round(sqrt(avg(d * d)), 5) AS rmse, round(corr(a, b), 8) AS r FROM d GROUP BY 1""")
def agreement_by_flag(spark, d):
    p = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), F.col("p_retailprice").alias("b"))
    return rounded(rounded(C.agreement_by(p, ["l_returnflag"], "a", "b"), 5, "bias", "spread", "rmse"), 8, "r")
