"""Queries over the driver's tables, with their DuckDB equivalents where SQL can express them.

events stands for cells and points (user: cell, ts: epoch, value: height or position), lineitem binned by quantity and discount for a grid,
embeddings for waveforms and places, orders and customers for catalogs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellflow.functions import scalars as S
from cellflow.operators import arrays, budget, grid, joins, qc, solvers, spatial, spectral, stats
from cellflow.operators.store import keep
from cellflow.sources import readers
from cellflow.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", S.seconds(F.col("ts")).alias("t"), "props")


def rounded(df: DataFrame, k: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, k) for c in columns})


def price_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean price by discount (iy 0..10) and quantity (ix 0..49), dense."""
    cells = table(spark, d, "lineitem").groupBy(F.rint(F.col("l_discount") * 100).cast("int").alias("iy"), (F.col("l_quantity") - 1).cast("int").alias("ix")).agg(F.avg("l_extendedprice").alias("v"))
    return grid.densify(cells, 11, 50)


EV = "ev AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
GRID = """g0 AS (SELECT CAST(round_even(l_discount * 100, 0) AS INT) AS iy, CAST(l_quantity - 1 AS INT) AS ix, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
ids AS (SELECT CAST(i // 50 AS INT) AS iy, CAST(i % 50 AS INT) AS ix FROM range(550) AS r(i)), g AS (SELECT iy, ix, v FROM ids LEFT JOIN g0 USING (iy, ix))"""


# --- trends and robust statistics


@query(f"""WITH {EV}, o AS (SELECT min(t) AS t0 FROM ev WHERE value IS NOT NULL),
s AS (SELECT user_id, regr_slope(value, (t - t0) / 31557600) AS slope, regr_intercept(value, (t - t0) / 31557600) AS intercept, CAST(count(value) AS BIGINT) AS n,
 regr_syy(value, (t - t0) / 31557600) AS syy, regr_sxx(value, (t - t0) / 31557600) AS sxx, regr_sxy(value, (t - t0) / 31557600) AS sxy FROM ev, o GROUP BY 1)
SELECT user_id, CASE WHEN n >= 3 AND sxx > 0 THEN round(slope, 4) END AS slope, CASE WHEN n >= 3 AND sxx > 0 THEN round(intercept, 4) END AS intercept, n,
 CASE WHEN n >= 3 AND sxx > 0 THEN round(sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)), 4) END AS rmse FROM s""")
def cell_trend(spark, d):
    return rounded(stats.trend(events(spark, d), ["user_id"], "t", "value"), 4, "slope", "intercept", "rmse")


@query()
def cell_trend_robust(spark, d):
    return rounded(stats.robust_trend(events(spark, d), ["user_id"], keep, "t", "value"), 4, "slope", "intercept", "rmse")


@query("SELECT event_type, user_id, count(value) AS n, round(median(value), 6) AS median, round(mad(value) * 1.4826, 6) AS nmad FROM events GROUP BY 1, 2")
def nmad_by_cell(spark, d):
    return rounded(stats.nmad(events(spark, d), ["event_type", "user_id"], "value"), 6, "median", "nmad")


@query("""WITH s AS (SELECT user_id, median(value) AS m, mad(value) * 1.4826 AS s FROM events GROUP BY 1),
k AS (SELECT e.event_id, user_id FROM events e JOIN s USING (user_id) WHERE s = 0 OR abs(value - m) <= 3 * s)
SELECT event_id, user_id FROM k WHERE user_id IN (SELECT user_id FROM k GROUP BY 1 HAVING count(*) >= 3)""")
def drop_temporal_outliers(spark, d):
    return stats.drop_outliers(events(spark, d), ["user_id"], "value").select("event_id", "user_id")


@query("""SELECT l_returnflag, CASE WHEN l_extendedprice < 20000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'middle' ELSE 'high' END AS class, CAST(year(l_shipdate) AS INT) AS year,
 count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(median(l_extendedprice), 4) AS median,
 round(quantile_cont(l_extendedprice, 0.16), 4) AS p16, round(quantile_cont(l_extendedprice, 0.84), 4) AS p84 FROM lineitem GROUP BY ALL""")
def stratified_summary(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", qc.stratify(F.col("l_extendedprice"), [20000, 50000], ["low", "middle", "high"]).alias("class"), F.year("l_shipdate").alias("year"), "l_extendedprice")
    return rounded(stats.summarize(rows, ["l_returnflag", "class", "year"], "l_extendedprice"), 4, "mean", "std", "median", "p16", "p84")


BINS = """b AS (SELECT CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 30 THEN 1 WHEN l_quantity >= 30 AND l_quantity <= 50 THEN 2 END AS q,
 CASE WHEN l_discount >= 0.0 AND l_discount < 0.05 THEN 0 WHEN l_discount >= 0.05 AND l_discount <= 0.09 THEN 1 END AS k, l_quantity, l_discount, l_extendedprice AS v FROM lineitem),
i AS (SELECT * FROM b WHERE q IS NOT NULL AND k IS NOT NULL),
u AS (SELECT 1 AS nd, q, NULL AS k, v FROM i UNION ALL SELECT 1, NULL, k, v FROM i UNION ALL SELECT 2, q, k, v FROM i)"""
EDGES = {"l_quantity": [1, 10, 30, 50], "l_discount": [0.0, 0.05, 0.09]}


@query(f"""WITH {BINS} SELECT CAST(nd AS INT) AS nd, CAST(coalesce(q, -1) AS INT) AS l_quantity_bin, CAST(coalesce(k, -1) AS INT) AS l_discount_bin, [5.5, 20, 40][q + 1]::DOUBLE AS l_quantity_mid, [0.025, 0.07][k + 1]::DOUBLE AS l_discount_mid,
 count(*) AS count, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, CASE WHEN count(*) >= 300 THEN round(mad(v) * 1.4826, 4) END AS nmad FROM u GROUP BY nd, q, k""")
def nd_binning(spark, d):
    """Rows with a discount above 0.09 count in no bin, the marginals of quantity included."""
    out = stats.nd_binning(table(spark, d, "lineitem"), EDGES, "l_extendedprice", 300)
    return rounded(out, 4, "mean", "std", "median", "nmad").fillna(-1, ["l_quantity_bin", "l_discount_bin"])


@query(f"""WITH {BINS}, n AS (SELECT q, k, mad(v) * 1.4826 AS s FROM u WHERE nd = 2 GROUP BY q, k),
c AS (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5.5), 40) AS x, least(greatest(l_discount, 0.025), 0.07) AS y FROM lineitem),
w AS (SELECT *, CASE WHEN x < 20 THEN 0 ELSE 1 END AS i, CASE WHEN x < 20 THEN (x - 5.5) / 14.5 ELSE (x - 20) / 20 END AS a, (y - 0.025) / 0.045 AS e FROM c)
SELECT l_orderkey, l_linenumber, round((1 - a) * (1 - e) * p.s + (1 - a) * e * r.s + a * (1 - e) * t.s + a * e * z.s, 3) AS sigma
FROM w JOIN n p ON p.q = i AND p.k = 0 JOIN n r ON r.q = i AND r.k = 1 JOIN n t ON t.q = i + 1 AND t.k = 0 JOIN n z ON z.q = i + 1 AND z.k = 1""")
def binned_dispersion(spark, d):
    """The dispersion that quantity and discount explain, between the middles of bins."""
    rows = table(spark, d, "lineitem")
    model = stats.dispersion_model(stats.nd_binning(rows, EDGES, "l_extendedprice", 1, ("count", "nmad")), EDGES, "nmad", 1)
    return rounded(rows.select("l_orderkey", "l_linenumber", model(F.col("l_quantity"), F.col("l_discount")).alias("sigma")), 3, "sigma")


@query("""WITH r AS (SELECT o_orderpriority, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / 1000 AS r FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY r) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM r)
SELECT o_orderpriority, count(*) AS n, CAST(count(*) * 0.0625 AS DOUBLE) AS area_km2, round(-sum(r) * 1e6 * 0.0625 * 918 / 1e12, 6) AS gt, round(-median(r) * count(*) * 1e6 * 0.0625 * 918 / 1e12, 6) AS gt_robust,
 round(quantile_cont(r, 0.01), 5) AS p1, round(quantile_cont(r, 0.99), 5) AS p99, round(-sum(least(greatest(r, -40), 40)) * 1e6 * 0.0625 * 918 / 1e12, 6) AS gt_clip, round(avg(r), 6) AS mean, round(median(r), 5) AS median, round(min(r), 5) AS deepest,
 round(sum(CASE WHEN k <= greatest(1, floor(c * 0.05)) THEN greatest(-r, 0) ELSE 0 END) / sum(greatest(-r, 0)), 6) AS top5_share FROM k GROUP BY 1""")
def flux_totals(spark, d):
    o = table(spark, d, "orders")
    r = o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).select("o_orderpriority", ((F.col("o_totalprice") - F.col("m")) / 1000).alias("r"))
    return rounded(rounded(stats.integrate_flux(r, ["o_orderpriority"], "r", 0.0625, 40.0), 6, "gt", "gt_clip", "gt_robust", "top5_share", "mean"), 5, "p1", "p99", "median", "deepest")


@query("SELECT user_id, min(value) AS low, max(value) AS high, CAST(arg_max(event_id, ts) AS BIGINT) AS newest, CAST(arg_min(event_id, ts) AS BIGINT) AS oldest, count(DISTINCT event_type) AS kinds, bool_and(value > 0) AS all_positive, count(*) FILTER (value > 10) AS over FROM events GROUP BY 1")
def extremes_by_cell(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("event_id", "ts").alias("newest"), F.min_by("event_id", "ts").alias("oldest"), F.count_distinct("event_type").alias("kinds"), F.bool_and(F.col("value") > 0).alias("all_positive"), F.count_if(F.col("value") > 10).alias("over"))


# --- joins


@query(f"""WITH {EV} SELECT a.user_id, count(*) AS pairs, round(sum((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 / 31557600), 6) AS years FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.ts < b.ts
 AND (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 / 31557600 BETWEEN 0.01 AND 0.02 GROUP BY 1""")
def epoch_pairs(spark, d):
    p = joins.epoch_pairs(events(spark, d), "user_id", "ts", 0.01, 0.02)
    return rounded(p.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum("dt_yr").alias("years")), 6, "years")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2),
p AS (SELECT a.user_id, date_diff('day', a.day, b.day) AS gap, avg(b.v - a.v) AS rate FROM e a JOIN e b ON a.user_id = b.user_id AND a.day < b.day AND date_diff('day', a.day, b.day) <= 7 GROUP BY 1, 2)
SELECT user_id, round(median(rate), 6) AS rate, count(*) AS groups FROM p GROUP BY 1""")
def mean_then_median(spark, d):
    e = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = F.explode(F.sequence(F.lit(1), F.lit(7)))
    a = e.select("user_id", "v", w.alias("gap"), "day").select("user_id", "gap", F.col("v").alias("va"), F.date_add("day", F.col("gap")).alias("day"))
    p = a.join(e, ["user_id", "day"]).groupBy("user_id", "gap").agg(F.avg(F.col("v") - F.col("va")).alias("rate"))
    return rounded(p.groupBy("user_id").agg(F.median("rate").alias("rate"), F.count("*").alias("groups")), 6, "rate")


@query(f"""WITH {EV}, p AS (SELECT *, CAST(user_id % 10 AS DOUBLE) AS y FROM ev)
SELECT a.event_id AS id, any_value(a.value) AS h, median(b.value) AS h_ref, count(*) AS n, round(any_value(a.value) - median(b.value), 6) AS residual FROM p a JOIN p b ON sqrt((a.value - b.value) ** 2 + (a.y - b.y) ** 2) <= 2.5 AND abs(a.t - b.t) <= 14400
 WHERE a.event_type = 'purchase' AND b.event_type = 'click' GROUP BY 1 HAVING count(*) >= 3""")
def collocate(spark, d):
    e = events(spark, d).select("event_id", "event_type", F.col("value").alias("x"), (F.col("user_id") % 10).cast("double").alias("y"), "t", F.col("value").alias("h"))
    return rounded(joins.collocate(e.where("event_type = 'purchase'").withColumnRenamed("event_id", "id"), e.where("event_type = 'click'"), 2.5, 14400.0), 6, "residual")


@query(f"""WITH {EV}, m AS (SELECT a.event_id AS id, b.t AS rt, b.value AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.value) AS k FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.t - b.t) < 21600
 WHERE a.event_type = 'purchase' AND b.event_type = 'click') SELECT id, round(rt, 3) AS rt, v FROM m WHERE k = 1""")
def nearest_in_time(spark, d):
    e = events(spark, d)
    left, right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), "t"), e.where("event_type = 'click'").select("user_id", "t", F.col("value").alias("v"))
    return rounded(joins.nearest_in_time(left, right, "user_id", 21600.0), 3, "rt")


@query(f"""WITH {EV}, a AS (SELECT user_id, event_id AS id, t FROM ev WHERE event_type = 'purchase'), r AS (SELECT user_id, t, value AS v FROM ev WHERE event_type = 'click'),
p AS (SELECT a.*, r.t AS pt, r.v AS pv FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t >= r.t),
q AS (SELECT p.*, r.t AS qt, r.v AS qv FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.t <= r.t)
SELECT user_id, id, round(CASE WHEN pt IS NULL THEN qv WHEN qt IS NULL THEN pv WHEN qt > pt THEN pv + (qv - pv) * (t - pt) / (qt - pt) ELSE pv END, 6) AS v FROM q""")
def interpolate_at(spark, d):
    e = events(spark, d)
    left, right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), "t"), e.where("event_type = 'click'").select("user_id", "t", F.col("value").alias("v"))
    return rounded(joins.interpolate_at(left, right, "user_id"), 6, "v")


@query("""WITH s AS (SELECT event_type, user_id * 100 + day(ts) AS id, min(ts) AS t0, max(ts) + INTERVAL 5 MINUTE AS t1 FROM events GROUP BY 1, 2)
SELECT a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.t0 <= b.t1 AND b.t0 <= a.t1 WHERE a.event_type = 'error' AND b.event_type = 'purchase'""")
def interval_overlaps(spark, d):
    """Users' days, from their first to five minutes after their last event of a kind."""
    s = events(spark, d).groupBy((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("id"), "event_type").agg(F.min("ts").alias("t0"), (F.max("ts") + F.expr("INTERVAL 5 MINUTES")).alias("t1"))
    return joins.overlaps(s.where("event_type = 'error'"), s.where("event_type = 'purchase'"), 1)


@query("""WITH e AS (SELECT l_orderkey AS id, sum(l_quantity) AS v FROM lineitem GROUP BY 1), dd AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, coalesce(e.v, dd.v, 2.0) AS v FROM orders LEFT JOIN e ON e.id = o_orderkey LEFT JOIN dd ON dd.date = CAST(o_orderdate AS DATE)""")
def id_then_date(spark, d):
    """Orders without lines fall back to the day's lines."""
    li = table(spark, d, "lineitem")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    exact = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("v"))
    return joins.id_then_date(rows, exact, li.select(F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("v")), F.lit(2.0))


@query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT') AND c_acctbal > 0""")
def not_yet_ordered(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return qc.without(c, table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def suppliers_with_returns(spark, d):
    hit = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(hit, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("""SELECT user_id, day, event_id, event_type FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
 ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS k FROM events) WHERE k = 1""")
def first_by_priority(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    order = [F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2), F.col("ts"), F.col("event_id")]
    return joins.first_by_priority(e, ["user_id", "day"], order).select("user_id", "day", "event_id", "event_type")


# --- screens


@query("SELECT l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 30 GROUP BY 1")
def half_open_window(spark, d):
    rows = qc.time_window(table(spark, d, "lineitem"), "l_shipdate", "1996-01-01", "1997-01-01").where(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(5, 30))
    return rounded(rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total")), 2, "total")


@query("SELECT user_id, count(value) AS n, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1 HAVING count(value) >= 5 AND stddev_pop(value) <= (SELECT median(x) FROM (SELECT stddev_pop(value) AS x FROM events GROUP BY user_id))")
def static_control_mask(spark, d):
    e = events(spark, d)
    limit = stats.median_of_all(e.groupBy("user_id").agg(F.stddev_pop("value").alias("x")), "x")
    return rounded(qc.static_mask(e, ["user_id"], "value", 5, limit or 0.0), 6, "std")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey < 20 AND c_acctbal > 0
 AND c_custkey NOT IN (SELECT user_id FROM events WHERE value < 0.5 GROUP BY 1 HAVING count(*) >= 2)""")
def min_extent(spark, d):
    """Most customers (cells) have no event: they were never observed, and stay."""
    c = table(spark, d, "customer")
    cells = events(spark, d).select(F.col("user_id").alias("c_custkey"), "value")
    return qc.min_extent(cells, c.where("c_nationkey < 20"), ["c_custkey"], "value", 0.5, 2, c.where("c_acctbal > 0"))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS epoch, median(value) - (SELECT median(value) FROM events) AS end_p50, CASE WHEN count(*) % 7 <> 0 THEN avg(1 / (1 + abs(value))) END AS weight_mean FROM events GROUP BY 1)
SELECT epoch, round(end_p50, 6) AS end_p50, round(weight_mean, 6) AS weight_mean FROM s WHERE abs(coalesce(end_p50, 0)) > 0.8 OR coalesce(weight_mean, 0) < 0.16""")
def bad_epochs(spark, d):
    e = events(spark, d)
    mid = e.agg(F.median("value").alias("m"))
    s = e.groupBy(F.to_date("ts").alias("epoch")).agg(F.median("value").alias("p"), F.when(F.count("*") % 7 != 0, F.avg(1 / (1 + F.abs("value")))).alias("weight_mean")).crossJoin(F.broadcast(mid))
    return rounded(qc.bad_epochs(s.select("epoch", (F.col("p") - F.col("m")).alias("end_p50"), "weight_mean"), 0.8, 0.16), 6, "end_p50", "weight_mean")


@query("""WITH s AS (SELECT user_id, event_type AS variant, count(value) AS n, median(value) - 10 AS "offset", mad(value) * 1.4826 AS spread FROM events GROUP BY 1, 2)
SELECT user_id, variant, CASE WHEN variant NOT IN ('error', 'click') THEN NULL WHEN n < 8 THEN 'sparse' WHEN abs("offset") > 6 THEN 'offset' WHEN spread > 9 THEN 'wide' END AS reason FROM s""")
def screen_unrescued(spark, d):
    s = stats.nmad(events(spark, d), ["user_id", "event_type"], "value").select("user_id", F.col("event_type").alias("variant"), "n", (F.col("median") - 10).alias("offset"), F.col("nmad").alias("spread"))
    return qc.screen_unrescued(s, ["error", "click"], 8, 6.0, 9.0).select("user_id", "variant", "reason")


@query("""WITH m AS (SELECT median(l_quantity) AS a, mad(l_quantity) AS da, median(l_extendedprice) AS b, mad(l_extendedprice) AS db FROM lineitem)
SELECT l_orderkey, l_linenumber, 'l_quantity' AS reason FROM lineitem, m WHERE l_quantity > a + 1.2 * 1.4826 * da UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice' FROM lineitem, m WHERE l_extendedprice > b + 1.2 * 1.4826 * db""")
def cohort_reject(spark, d):
    rows = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_extendedprice")
    return qc.cohort_reject(rows, "k", ["l_quantity", "l_extendedprice"], 1.2).select("k.*", "reason")


@query("""WITH RECURSIVE n AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS i, list(DISTINCT user_id) AS u, stddev_pop(value) AS s FROM events GROUP BY 1),
o AS (SELECT a.i, b.i AS j, len(list_intersect(a.u, b.u)) / least(len(a.u), len(b.u)) AS overlap, a.s AS si, b.s AS sj FROM n a JOIN n b ON b.i - a.i BETWEEN 1 AND 7),
p AS (SELECT *, row_number() OVER (ORDER BY overlap DESC, i, j) AS k FROM o WHERE overlap >= 0.5),
w(k, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INT[]) UNION ALL SELECT p.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, CASE WHEN si > sj THEN i ELSE j END) END FROM w JOIN p ON p.k = w.k + 1)
SELECT unnest(gone) AS dropped FROM w WHERE k = (SELECT max(k) FROM w)""")
def greedy_dedup(spark, d):
    days = events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.collect_set("user_id").alias("u"), F.stddev_pop("value").alias("s"))
    n = days.select(F.datediff("day", F.lit("2024-01-01").cast("date")).alias("i"), "u", "s")
    a, b = n.select(*[F.col(c).alias(f"{c}_i") for c in ("i", "u", "s")]), n.select(*[F.col(c).alias(f"{c}_j") for c in ("i", "u", "s")])
    share = F.size(F.array_intersect("u_i", "u_j")) / F.least(F.size("u_i"), F.size("u_j"))
    # A day meets the seven after it by key.
    p = a.withColumn("i_j", F.explode(F.sequence(F.col("i_i") + 1, F.col("i_i") + 7))).join(b, "i_j").select(F.col("i_i").alias("i"), F.col("i_j").alias("j"), share.alias("overlap"), F.col("s_i").alias("sigma_i"), F.col("s_j").alias("sigma_j")).where("overlap >= 0.5")
    return spark.createDataFrame([(x,) for x in qc.greedy_dedup(p)], "dropped int")


# --- windows


@query("""WITH y AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_suppkey, abs(m - lag(m) OVER (PARTITION BY l_suppkey ORDER BY year)) AS step FROM y) SELECT l_suppkey, round(max(step), 4) AS largest_step FROM s GROUP BY 1""")
def largest_yearly_step(spark, d):
    y = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("m"))
    s = y.withColumn("step", F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("l_suppkey").orderBy("year"))))
    return rounded(s.groupBy("l_suppkey").agg(F.max("step").alias("largest_step")), 4, "largest_step")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_integral(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(events(spark, d).select("event_id", F.sum("value").over(w).alias("running")), 4, "running")


@query("""WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 AS half FROM events),
h AS (SELECT user_id, avg(value) FILTER (half = 0) AS a, avg(value) FILTER (half = 1) AS b FROM k GROUP BY 1) SELECT user_id, round((a - b) / 2, 6) AS noise FROM h""")
def half_split_noise(spark, d):
    k = events(spark, d).withColumn("half", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) % 2)
    side = lambda h: F.avg(F.when(F.col("half") == h, F.col("value")))
    return rounded(k.groupBy("user_id").agg(((side(0) - side(1)) / 2).alias("noise")), 6, "noise")


@query("""WITH c AS (SELECT c_custkey, c_acctbal, sum(o_totalprice) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT c_acctbal, s, rank() OVER (ORDER BY c_acctbal) AS ra, rank() OVER (ORDER BY s) AS rb FROM c) SELECT round(corr(c_acctbal, s), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""")
def agreement(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_acctbal").agg(F.sum("o_totalprice").alias("s"))
    for v, r in (("c_acctbal", "ra"), ("s", "rb")):
        c = stats.ranked(c, v, r, keep)
    return rounded(c.agg(F.corr("c_acctbal", "s").alias("pearson"), F.corr("ra", "rb").alias("spearman")), 6, "pearson", "spearman")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def top_report(spark, d):
    return table(spark, d, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT user_id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'purchase only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_operations(spark, d):
    e = events(spark, d)
    a, b = (e.where(F.col("event_type") == k).select("user_id").distinct() for k in ("purchase", "error"))
    named = lambda df, s: df.select("user_id", F.lit(s).alias("side"))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "purchase only")).unionByName(named(a.union(b).distinct(), "any"))


# --- grids


@query(f"WITH {GRID} SELECT iy, ix, round(CASE WHEN ix = 0 THEN (lead(v) OVER x - v) / 250 WHEN ix = 49 THEN (v - lag(v) OVER x) / 250 ELSE (lead(v) OVER x - lag(v) OVER x) / 500 END, 6) AS dx, round(CASE WHEN iy = 0 THEN (lead(v) OVER y - v) / 250 WHEN iy = 10 THEN (v - lag(v) OVER y) / 250 ELSE (lead(v) OVER y - lag(v) OVER y) / 500 END, 6) AS dy FROM g WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy)")
def grid_gradient(spark, d):
    g = price_grid(spark, d)
    return rounded(g.withColumn("dx", grid.differentiate(g, "v", "ix", 250.0)).withColumn("dy", grid.differentiate(g, "v", "iy", 250.0)), 6, "dx", "dy").select("iy", "ix", "dx", "dy")


@query(f"""WITH {GRID}, f AS (SELECT iy, ix, v * (100 + ix) AS fx, v * (iy - 5) * 10 AS fy FROM g),
e AS (SELECT iy, ix, CASE WHEN ix = 0 THEN (lead(fx) OVER x - fx) / 250 WHEN ix = 49 THEN (fx - lag(fx) OVER x) / 250 ELSE (lead(fx) OVER x - lag(fx) OVER x) / 500 END AS a, CASE WHEN iy = 0 THEN (lead(fy) OVER y - fy) / 250 WHEN iy = 10 THEN (fy - lag(fy) OVER y) / 250 ELSE (lead(fy) OVER y - lag(fy) OVER y) / 500 END AS b FROM f WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy))
SELECT iy, ix, round(a - b, 4) AS divergence FROM e""")
def flux_divergence(spark, d):
    g = price_grid(spark, d).withColumn("vx", 100.0 + F.col("ix")).withColumn("vy", (F.col("iy") - 5) * 10.0)
    return rounded(grid.flux_divergence(g, "v", "vx", "vy", 250.0), 4, "divergence").select("iy", "ix", "divergence")


@query(f"""WITH {GRID}, o AS (SELECT a.i - 1 AS dy, b.i - 1 AS dx FROM range(3) AS a(i), range(3) AS b(i))
SELECT g.iy, g.ix, round(sum(h.v) / 9, 4) AS v FROM g, o JOIN g h ON h.iy = least(greatest(g.iy + dy, 0), 10) AND h.ix = least(greatest(g.ix + dx, 0), 49) GROUP BY 1, 2""")
def box_smooth(spark, d):
    return rounded(grid.box_mean(price_grid(spark, d), "v", 3), 4, "v")


@query(f"""WITH {GRID} SELECT a.iy, a.ix, round(sum(b.v * exp(-((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) / (2 * 1.5 ** 2))) / sum(exp(-((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) / (2 * 1.5 ** 2))), 4) AS smooth
 FROM g a JOIN g b ON abs(a.ix - b.ix) <= 3 AND abs(a.iy - b.iy) <= 3 WHERE b.v IS NOT NULL GROUP BY 1, 2""")
def gaussian_smooth(spark, d):
    return rounded(grid.gaussian_mean(price_grid(spark, d), "v", 1.5, 3), 4, "smooth").select("iy", "ix", "smooth")


POINTS = "pt AS (SELECT event_id AS id, (value * 7) % 12 - 0.5 AS fy, (value * 13) % 51 - 0.25 AS fx FROM events)"


def grid_points(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("event_id").alias("id"), ((F.col("value") * 7) % 12 - 0.5).alias("fy"), ((F.col("value") * 13) % 51 - 0.25).alias("fx"))


@query(f"""WITH {GRID}, {POINTS}, q AS (SELECT *, CAST(floor(fy) AS INT) AS y0, CAST(floor(fx) AS INT) AS x0, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM pt),
c AS (SELECT id, y0 + a.i AS iy, x0 + b.i AS ix, (CASE a.i WHEN 0 THEN 1 - wy ELSE wy END) * (CASE b.i WHEN 0 THEN 1 - wx ELSE wx END) AS w FROM q, range(2) AS a(i), range(2) AS b(i))
SELECT id, CASE WHEN bool_and(v IS NOT NULL) THEN round(sum(w * v), 4) END AS value FROM c LEFT JOIN g USING (iy, ix) WHERE w > 0 GROUP BY 1""")
def bilinear_gather(spark, d):
    return rounded(grid.gather_bilinear(grid_points(spark, d), price_grid(spark, d), "v"), 4, "value")


@query(f"WITH {GRID}, {POINTS} SELECT id, round(n.v, 7) AS nearest, round(c.v, 7) AS ceiling FROM pt LEFT JOIN g n ON n.iy = CAST(round_even(fy, 0) AS INT) AND n.ix = CAST(round_even(fx, 0) AS INT) LEFT JOIN g c ON c.iy = CAST(ceil(fy) AS INT) AND c.ix = CAST(ceil(fx) AS INT)")
def index_gather(spark, d):
    p, g = grid_points(spark, d), price_grid(spark, d)
    both = grid.gather_index(p, g, "v").withColumnRenamed("value", "nearest").join(grid.gather_index(p, g, "v", "ceiling").withColumnRenamed("value", "ceiling"), "id")
    return rounded(both, 7, "nearest", "ceiling")


# --- budgets and spatial statistics


def height_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = events(spark, d).select(F.floor(F.col("user_id") / 16).cast("int").alias("iy"), (F.col("user_id") % 16).cast("int").alias("ix"), "t", F.col("value").alias("z"))
    ids = spark.range(256 * 16).select(F.floor(F.col("id") / 16).cast("int").alias("iy"), (F.col("id") % 16).cast("int").alias("ix"))
    return cells, ids.withColumn("vx", 200.0 + F.col("ix")).withColumn("vy", F.col("iy") * 1.0).withColumn("a_dot", F.lit(0.3))


@query(f"""WITH {EV}, c AS (SELECT CAST(user_id // 16 AS INT) AS iy, CAST(user_id % 16 AS INT) AS ix, t, value * 1027 / 109.0 AS h FROM ev), o AS (SELECT min(t) AS t0 FROM c),
f AS (SELECT iy, ix, CASE WHEN count(h) >= 3 THEN regr_slope(h, (t - t0) / 31557600) END AS dhdt, avg(h) AS h, count(h) AS n FROM c, o GROUP BY 1, 2),
ids AS (SELECT CAST(i // 16 AS INT) AS iy, CAST(i % 16 AS INT) AS ix FROM range(4096) AS r(i)), g AS (SELECT iy, ix, dhdt, n, h * (200 + ix) AS fx, h * iy AS fy FROM ids LEFT JOIN f USING (iy, ix)),
e AS (SELECT iy, ix, dhdt, n, CASE WHEN ix = 0 THEN (lead(fx) OVER x - fx) / 250 WHEN ix = 15 THEN (fx - lag(fx) OVER x) / 250 ELSE (lead(fx) OVER x - lag(fx) OVER x) / 500 END
 - CASE WHEN iy = 0 THEN (lead(fy) OVER y - fy) / 250 WHEN iy = 255 THEN (fy - lag(fy) OVER y) / 250 ELSE (lead(fy) OVER y - lag(fy) OVER y) / 500 END AS div FROM g WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy))
SELECT iy, ix, coalesce(n, 0) AS n, round(div, 4) AS divergence, round(dhdt + div - 0.3, 3) AS rate FROM e""")
def eulerian_rate(spark, d):
    return rounded(rounded(budget.eulerian(*height_cells(spark, d), 250.0), 4, "divergence"), 3, "rate").select("iy", "ix", F.coalesce("n", F.lit(0)).alias("n"), "divergence", "rate")


def shelf(spark: SparkSession, d: str) -> DataFrame:
    """Four start epochs of a shelf that thins along its flow and year by year, 11 x 50 cells with the prices' gaps; each start has its later
    epochs as partners and a velocity that grows by a tenth a year."""
    g = price_grid(spark, d).withColumn("h", 300 - 0.005 * 250 * F.col("ix") + F.coalesce("v", F.lit(0.0)) * 1e-6)
    pack = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("iy", "ix", c.alias("v")))), lambda x: x["v"])
    field = g.groupBy(F.lit(0).alias("_")).agg(pack(F.col("h")).alias("h"), pack(F.lit(200.0)).alias("vx"), pack(F.lit(0.0)).alias("vy"), pack(F.lit(0.0)).alias("div"), pack(F.lit(0.3)).alias("a_dot"))
    later = lambda k: F.transform("h", lambda x: x - 0.7 * k)
    faster = lambda t: F.struct(t.cast("double").alias("t"), F.transform("vx", lambda x: x * (1 + 0.1 * t)).alias("vx"), F.col("vy"))
    starts = field.crossJoin(F.broadcast(spark.range(4).select(F.col("id").alias("start"))))
    partners = F.transform(F.sequence(F.col("start") + 1, F.lit(4).cast("long")), lambda k: F.struct(((k - F.col("start")) * 0.5).alias("dt"), later(k * 0.5).alias("H1")))
    return starts.select("start", later(F.col("start") * 0.5).alias("H0"), "vx", "vy", "div", "a_dot", partners.alias("partners"), F.array(faster(F.lit(0.0)), faster(F.lit(1.0)), faster(F.lit(2.5))).alias("flow"))


@query()
def lagrangian_rate(spark, d):
    return rounded(budget.pair_median(budget.lagrangian(shelf(spark, d), (11, 50), 250.0)), 6, "rate")


@query()
def lagrangian_origin(spark, d):
    return rounded(budget.pair_median(budget.lagrangian(shelf(spark, d), (11, 50), 250.0, output="origin")), 6, "rate")


PLACES = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings)"
LAGS = f"{PLACES}, q AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.v - b.v AS dv FROM p a JOIN p b ON a.id < b.id), l AS (SELECT CASE WHEN d < 0.02 THEN 0 WHEN d < 0.05 THEN 1 ELSE 2 END AS bin, dv FROM q WHERE d < 0.1)"


def places(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.get("embedding", k).cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("v"))


@query(f"""WITH {LAGS}, m AS (SELECT bin, count(*) AS n, avg(dv * dv) / 2 AS matheron, (1.4826 * median(abs(dv))) ** 2 / 2 AS dowd FROM l GROUP BY 1 HAVING count(*) >= 10)
SELECT CAST(bin AS INT) AS bin, [0.01, 0.035, 0.075][bin + 1]::DOUBLE AS lag, n, round(matheron, 8) AS matheron, round(dowd, 8) AS dowd FROM m""")
def variogram(spark, d):
    one = lambda how: rounded(spatial.variogram(places(spark, d), [0.0, 0.02, 0.05, 0.1], how, 10), 8, "gamma").withColumnRenamed("gamma", how)
    return rounded(one("matheron").join(one("dowd").drop("lag", "n"), "bin"), 6, "lag")


@query(f"""WITH {LAGS}, c AS (SELECT count(*) AS n FROM p), w AS (SELECT avg(0.25 - 0.06 - 0.19 * CASE WHEN d < 0.5 THEN 1.5 * d / 0.5 - 0.5 * (d / 0.5) ** 3 ELSE 1 END) AS off FROM q)
SELECT n AS n_points, round(off, 9) AS mean_offdiag_cov, round(sqrt(0.25 / n + (1 - 1.0 / n) * off), 7) AS standard_error, round(0.25 / (0.25 / n + (1 - 1.0 / n) * off), 5) AS n_eff FROM w, c""")
def error_of_mean(spark, d):
    """All pairs of points, however many."""
    e = spatial.effective_samples(places(spark, d), [("nugget", 0.06, 0.0), ("spherical", 0.19, 0.5)], None)
    out = spark.createDataFrame([(e["n_points"], e["mean_offdiag_cov"], math.sqrt(e["var_mean"]), e["n_eff"])], "n_points long, mean_offdiag_cov double, standard_error double, n_eff double")
    return rounded(rounded(rounded(out, 9, "mean_offdiag_cov"), 7, "standard_error"), 5, "n_eff")


# --- arrays, scalars, text


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)
SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS BIGINT) AS peak, round(list_sum(list_transform(a, lambda x, i: x * x * (i - 1))) / list_sum(list_transform(a, lambda x: x * x)), 6) AS centre,
 CAST(list_min(list_filter(list_transform(a, lambda x, i: CASE WHEN x > 0.5 * list_max(a) THEN i - 1 END), lambda i: i IS NOT NULL)) AS INT) AS edge,
 round(list_max(list_transform(a, lambda x, i: list_avg(a[greatest(i - 2, 1):least(i + 2, len(a))]))), 6) AS smooth_peak FROM w""")
def waveform_features(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    a = F.col("a")
    out = w.select("vec_id", arrays.peak(a).cast("long").alias("peak"), arrays.centre_of_gravity(a).alias("centre"), arrays.first_over(a, 0.5).alias("edge"), F.array_max(arrays.moving_mean(a, 5)).alias("smooth_peak"))
    return rounded(out, 6, "centre", "smooth_peak")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, upper(event_type) AS kind, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour,
 round(year(ts) + (epoch_us(ts) / 1e6 - epoch(make_date(year(ts), 1, 1))) / (date_diff('day', make_date(year(ts), 1, 1), make_date(year(ts) + 1, 1, 1)) * 86400), 9) AS decimal_year,
 round_even(value, 0) AS half_even, round(value * 1027 / 109.0, 6) AS thickness, round((value + 1000 - 1013.25) * -0.01, 6) + 0.0 AS pressure, CASE WHEN value - 5 > 0 THEN round(100 / (value - 5), 6) END AS ratio, round(degrees(atan2(value, 3)), 6) AS angle FROM events""")
def scalar_functions(spark, d):
    v = F.col("value")
    return events(spark, d).select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.upper("event_type").alias("kind"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.round(S.decimal_year(F.col("ts")), 9).alias("decimal_year"),
        S.half_even(v).alias("half_even"), F.round(S.thickness(v), 6).alias("thickness"), (F.round(S.inverse_barometer(v + 1000), 6) + F.lit(0.0)).alias("pressure"), F.round(S.guarded_ratio(F.lit(100.0), v - 5), 6).alias("ratio"), F.round(F.degrees(F.atan2(v, F.lit(3.0))), 6).alias("angle"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number, contains(lower(html), '<nav>') AS has_nav, CAST(length(html) AS INT) AS size,
 array_to_string(list_slice(string_split(url, '/'), 4, 4), '') AS section FROM pages""")
def string_functions(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://([^/]+)", 2).alias("host"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).alias("number"), F.lower("html").contains("<nav>").alias("has_nav"), F.length("html").alias("size"), F.coalesce(F.get(F.split("url", "/"), 3), F.lit("")).alias("section"))


@query("""WITH p AS (SELECT event_id, radians(value * 3 - 180) AS lam, radians(60 + value / 10) AS phi FROM events),
c AS (SELECT 6378137.0 AS a, 0.0818191908426215 AS e, radians(71.0) AS s),
k AS (SELECT *, tan(pi() / 4 - s / 2) / pow((1 - e * sin(s)) / (1 + e * sin(s)), e / 2) AS tc, cos(s) / sqrt(1 - (e * sin(s)) ** 2) AS mc FROM c),
r AS (SELECT event_id, lam, a * mc * tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) / tc AS rho FROM p, k)
SELECT event_id, round(rho * sin(lam), 3) AS x, round(rho * cos(lam), 3) AS y FROM r""")
def polar_projection(spark, d):
    x, y = S.polar_stereographic(F.col("value") * 3 - 180, -(60 + F.col("value") / 10))
    return events(spark, d).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""SELECT vec_id, round(0.06 + 0.19 * CASE WHEN h < 1 THEN 1.5 * h - 0.5 * h ** 3 ELSE 1 END, 8) AS spherical, round(0.06 + 0.19 * (1 - exp(-3 * h)), 8) AS exponential, round(0.06 + 0.19 * (1 - exp(-4 * h * h)), 8) AS gaussian
 FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 20 AS h FROM embeddings)""")
def variogram_models(spark, d):
    lag = F.abs(F.get("embedding", 0).cast("double")) * 20
    return table(spark, d, "embeddings").select("vec_id", *[F.round(spatial.model_column(lag, [("nugget", 0.06, 0.0), (k, 0.19, 1.0)]), 8).alias(k) for k in ("spherical", "exponential", "gaussian")])


@query("""SELECT 'a' AS src, CAST(value AS DOUBLE) AS x, epoch_us(ts) / 1e6 AS y, value AS h, CAST(event_id + 0.5 AS DOUBLE) AS quality FROM events WHERE event_type = 'click' UNION ALL
SELECT 'b', CAST(value AS DOUBLE), epoch_us(ts) / 1e6, value, NULL FROM events WHERE event_type = 'error' AND value IS NOT NULL""")
def points_union(spark, d):
    e = events(spark, d).withColumn("x", F.col("value")).withColumn("y", F.col("t")).withColumn("h", F.col("value"))
    a = e.where("event_type = 'click'").select(F.lit("a").alias("src"), "x", "y", "h", (F.col("event_id") + 0.5).alias("quality"))
    return readers.points_union([a, e.where("event_type = 'error'").select(F.lit("b").alias("src"), "x", "y", "h")])


# --- streams


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return rounded(streams.windowed(table(spark, d, "events"), "ts", ["event_type"], "6 hours"), 4, "total").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", "user_id", "12 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- solvers


@query()
def epoch_offsets(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("cell"), F.to_date("ts").alias("epoch"), (F.col("t") / S.SECONDS_PER_YEAR).alias("t"), F.col("value").alias("z"))
    return rounded(solvers.epoch_offsets(e, keep)[1], 6, "offset")


@query()
def kmeans_geometry(spark, d):
    return solvers.kmeans(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 4)


@query()
def principal_components(spark, d):
    share, vectors = solvers.principal_components(table(spark, d, "embeddings"), "embedding", 5)
    return spark.createDataFrame([(k, float(s), [float(x) for x in v]) for k, (s, v) in enumerate(zip(share, vectors, strict=True))], "component int, share double, vector array<double>")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM ev),
f(user_id, k, t, level, variance) AS (SELECT user_id, k, t, value, CAST(4.0 AS DOUBLE) FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, o.t, f.level + (p.p / (p.p + 4.0)) * (o.value - f.level), (1 - p.p / (p.p + 4.0)) * p.p FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1, LATERAL (SELECT f.variance + 1e-5 * (o.t - f.t) AS p) p)
SELECT user_id, t, round(level, 6) AS level, round(variance, 6) AS variance FROM f""")
def kalman_series(spark, d):
    return rounded(solvers.kalman(events(spark, d), "user_id", "t", "value", 1e-5, 4.0), 6, "level", "variance")


@query()
def radial_spectrum(spark, d):
    return rounded(spectral.radial_spectrum(price_grid(spark, d).withColumn("field", F.lit("price")), "field", "v", 250.0, 8), 4, "power")
