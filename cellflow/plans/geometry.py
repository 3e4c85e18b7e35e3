"""More queries of the catalog: names, corrections, footprints, planes and the plate's response."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellflow.functions import corrections as C
from cellflow.functions import names as N
from cellflow.functions import scalars as S
from cellflow.operators import footprints, grid, plate, stats
from cellflow.operators.store import keep

from .catalog import GRID, events, price_grid, query, rounded, table


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + INTERVAL 6 HOUR AS start, CAST(o_orderdate AS DATE) + INTERVAL 7 HOUR AS stop, lower(trim(o_orderstatus, ' ')) AS bare, '_' || lower(o_orderstatus) AS suffix,
 CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'dear+done' WHEN o_totalprice > 300000 THEN 'dear' WHEN o_orderstatus = 'F' THEN 'done' ELSE '?' END AS reason FROM orders""")
def names_and_reasons(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    o = table(spark, d, "orders").withColumn("name", F.concat(F.lit("strip_"), day, F.lit("_"), day, F.lit("T060000_"), day, F.lit("T070000_v1")))
    start, stop = N.span_in_name(F.col("name"))
    status = F.col("o_orderstatus")
    return o.select("o_orderkey", N.date_in_name(F.col("name")).alias("day"), start.cast("timestamp_ntz").alias("start"), stop.cast("timestamp_ntz").alias("stop"), F.lower(F.trim(status)).alias("bare"), N.canonical_suffix(F.concat(F.lit(" _"), status, F.lit(" "))).alias("suffix"), N.reasons(dear=F.col("o_totalprice") > 300000, done=status == "F").alias("reason"))


@query("""SELECT DISTINCT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month FROM (SELECT unnest(generate_series(date_trunc('month', CAST(o_orderdate AS DATE) - 45), date_trunc('month', CAST(o_orderdate AS DATE) + 45), INTERVAL 1 MONTH)) AS m
 FROM orders WHERE o_orderpriority = '1-URGENT')""")
def months_to_fetch(spark, d):
    m = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day")).distinct().select(F.explode(N.months_touched(F.col("day"), 45)).alias("m"))
    return m.select(F.year("m").alias("year"), F.month("m").alias("month")).distinct()


@query("""SELECT event_id, round(value - (0.01 * (user_id - 75) + 0.002 * (event_id - 100) + 0.5), 6) AS level, round(value * 109.0 / 1027 + 2, 6) AS freeboard, round(value / 918, 8) AS ice,
 round(CASE WHEN user_id % 3 = 2 THEN value ELSE value - 0.3 * (user_id % 5) END, 6) AS over_water, round(299792458.0 / 2 * 0.005 + (value - 64) * 0.2342 + 1.5, 5) AS range_m,
 round(value * 20 - 360 * floor((value * 20 + 180) / 360), 6) AS lon FROM events""")
def corrections(spark, d):
    v, u, i = F.col("value"), F.col("user_id"), F.col("event_id")
    one = lambda x: F.lit(x)
    return events(spark, d).select(
        "event_id", F.round(C.remove_tilt(v, u, i, one(0.01), one(0.002), one(0.5), 75, 100), 6).alias("level"), F.round(C.freeboard(v, 2.0), 6).alias("freeboard"), F.round(C.ice_equivalent(v), 8).alias("ice"),
        F.round(C.over_water(v, 0.3 * (u % 5), u % 3), 6).alias("over_water"), F.round(C.range_from_gate(one(0.005), v, one(1.5), 0.2342, 64), 5).alias("range_m"), F.round(C.wrap180(v * 20), 6).alias("lon"))


@query("SELECT event_id, round(least(value * 1.2, 179), 6) AS lon, round(-(60 + least(value, 250) / 10), 6) AS lat FROM events WHERE value IS NOT NULL")
def lonlat_round_trip(spark, d):
    lon, lat = F.least(F.col("value") * 1.2, F.lit(179.0)), -(60 + F.least(F.col("value"), F.lit(250.0)) / 10)
    there = events(spark, d).where("value is not null").select("event_id", *[c.alias(n) for c, n in zip(S.polar_stereographic(lon, lat), "xy", strict=True)])
    back = C.lonlat(F.col("x"), F.col("y"))
    return there.select("event_id", F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"))


BOXES = """b AS (SELECT user_id * 1000 + dayofyear(ts) AS id, event_type, min(value) - 0.5 AS x0, min(hour(ts)) - 0.5 AS y0, max(value) + 0.5 AS x1, max(hour(ts)) + 0.5 AS y1
 FROM events WHERE event_type IN ('purchase', 'click') AND value IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {BOXES} SELECT p.id, count(*) AS n, CAST(min(c.id) AS BIGINT) AS first FROM b p JOIN b c ON p.event_type = 'purchase' AND c.event_type = 'click' AND p.x0 <= c.x1 AND c.x0 <= p.x1 AND p.y0 <= c.y1 AND c.y0 <= p.y1 GROUP BY 1""")
def footprint_overlaps(spark, d):
    e = events(spark, d).where("event_type in ('purchase', 'click')").select("event_type", (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("id"), "value", F.hour("ts").alias("hour"))
    boxes = footprints.bounds(e, ["id", "event_type"], "value", "hour", 0.5)
    return footprints.overlap_counts(boxes.where("event_type = 'purchase'"), boxes.where("event_type = 'click'"), 12.0, keep)


RING = [(0.0, 0.0), (30.0, 4.0), (18.0, 22.0), (10.0, 9.0), (4.0, 20.0)]
_EDGES = ", ".join(f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(RING, RING[1:] + RING[:1], strict=True))


@query(f"""WITH edges(x0, y0, x1, y1) AS (VALUES {_EDGES}), p AS (SELECT event_id, value AS x, hour(ts) + 0.5 AS y FROM events)
SELECT event_id, count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0) % 2 = 1 AS inside FROM p, edges GROUP BY 1""")
def in_polygon(spark, d):
    return events(spark, d).select("event_id", footprints.inside(F.col("value"), F.hour("ts") + 0.5, RING).alias("inside"))


@query("""WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), c AS (SELECT d, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.d AS i, b.d AS j, count(*) AS shared FROM s a JOIN s b ON a.user_id = b.user_id AND a.d < b.d AND b.d - a.d <= 7 GROUP BY 1, 2)
SELECT i, j, shared, round(shared / least(x.n, y.n), 9) AS share FROM p JOIN c x ON i = x.d JOIN c y ON j = y.d WHERE shared / least(x.n, y.n) >= 0.05""")
def overlapping_epochs(spark, d):
    return rounded(footprints.shared_cells(events(spark, d).withColumn("day", F.to_date("ts")), "user_id", "day", 7, 0.05), 9, "share")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 50")
def capped_per_source(spark, d):
    return footprints.capped(events(spark, d).select("event_id", "event_type"), "event_type", "event_id", 50)


@query("""WITH m AS (SELECT user_id, CAST(hour(ts) AS DOUBLE) AS x, CAST(day(ts) AS DOUBLE) AS y, value AS z FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, avg(x) AS xc, avg(y) AS yc, avg(z) AS at_mean, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT user_id, xc, yc, at_mean, n, sum((x - xc) ** 2) AS sxx, sum((y - yc) ** 2) AS syy, sum((x - xc) * (y - yc)) AS sxy, sum((x - xc) * (z - at_mean)) AS sxz, sum((y - yc) * (z - at_mean)) AS syz, sum((z - at_mean) ** 2) AS szz FROM m JOIN c USING (user_id) GROUP BY ALL),
t AS (SELECT *, CASE WHEN n >= 4 AND sxx * syy - sxy ** 2 > 1e-12 * sxx * syy THEN sxx * syy - sxy ** 2 END AS det FROM s),
u AS (SELECT *, (syy * sxz - sxy * syz) / det AS ax, (sxx * syz - sxy * sxz) / det AS ay FROM t),
v AS (SELECT *, CASE WHEN det IS NOT NULL THEN sqrt(greatest(szz - ax * sxz - ay * syz, 0) / (n - 3)) END AS sd FROM u)
SELECT user_id, n, round(xc, 6) AS xc, round(yc, 6) AS yc, round(at_mean, 6) AS at_mean, round(ax, 6) AS ax, round(ay, 6) AS ay, round(sd, 5) AS sd, round(sd * sqrt(syy / det), 6) AS se_ax, round(sd * sqrt(sxx / det), 6) AS se_ay FROM v""")
def plane_by_cell(spark, d):
    rows = events(spark, d).select("user_id", F.hour("ts").cast("double").alias("x"), F.dayofmonth("ts").cast("double").alias("y"), "value")
    return rounded(rounded(stats.plane(rows, ["user_id"], "x", "y", "value"), 6, "xc", "yc", "at_mean", "ax", "ay", "se_ax", "se_ay"), 5, "sd")


@query()
def plane_by_cell_robust(spark, d):
    rows = events(spark, d).select("user_id", F.hour("ts").cast("double").alias("x"), F.dayofmonth("ts").cast("double").alias("y"), "value")
    return stats.robust_plane(rows, ["user_id"], "x", "y", "value", keep, 12)


@query("""WITH s AS (SELECT event_type, mad(value) * 1.4826 AS s FROM events GROUP BY 1), f AS (SELECT event_id, value / nullif(s, 0) AS z FROM events JOIN s USING (event_type))
SELECT event_id, round(z / (SELECT mad(z) * 1.4826 FROM f), 6) AS standard FROM f""")
def two_step_standard(spark, d):
    return stats.standardize(events(spark, d), ["event_type"], "value").select("event_id", F.round("standard", 6).alias("standard"))


@query("""WITH w AS (SELECT CAST(i // 50 AS INT) AS iy, CAST(i % 50 AS INT) AS ix FROM range(550) AS r(i)),
k AS (SELECT iy, ix, (CASE WHEN iy < 6 THEN iy ELSE iy - 11 END) * 2 * pi() / (11 * 250.0) AS ky, (CASE WHEN ix < 25 THEN ix ELSE ix - 50 END) * 2 * pi() / (50 * 250.0) AS kx FROM w),
q AS (SELECT *, nullif(sqrt(kx * kx + ky * ky) * 400, 0) AS h, (kx * 0.3 - ky * 0.1) * 400 AS a, 1027 / 918.0 - 1 AS d, 0.02 AS g FROM k),
e AS (SELECT *, h * (1 - 2 * (1 + 2 * h * h) * exp(-2 * h) + exp(-4 * h)) AS den FROM q),
f AS (SELECT *, coalesce((1 + 4 * h * exp(-2 * h) - exp(-4 * h)) / den, 0) AS r, coalesce(2 * ((h + 1) * exp(-h) + (h - 1) * exp(-3 * h)) / den, 0) AS b FROM e),
c AS (SELECT *, d * (r * r - b * b) - g * (d + 1) * r + g * g - a * a AS re, a * (d + 1) * r - 2 * g * a AS im FROM f)
SELECT iy, ix, round(r, 6) AS r, round(b, 6) AS b, round(CASE WHEN h IS NULL THEN g - d / (2 * (d + 1)) ELSE g - r * (1 + d) / 2 + sqrt(4 * d * b * b + r * r * (d - 1) ** 2) / 2 END, 7) AS growth,
 round(CASE WHEN h IS NULL THEN d / (d + 1) / (g - d / (2 * (d + 1))) ELSE -d * b * re / (re * re + im * im) END, 6) + 0.0 AS h_re, round(CASE WHEN h IS NULL THEN 0 ELSE d * b * im / (re * re + im * im) END, 6) + 0.0 AS h_im,
 round(CASE WHEN h IS NULL THEN -1 / (d + 1) / (g - d / (2 * (d + 1))) ELSE ((r - g) * re + a * im) / (re * re + im * im) END, 6) + 0.0 AS s_re, round(CASE WHEN h IS NULL THEN 0 ELSE (a * re - (r - g) * im) / (re * re + im * im) END, 6) + 0.0 AS s_im FROM c""")
def plate_response(spark, d):
    out = plate.steady_state(plate.wavenumbers(spark, 11, 50, 250.0), 400.0, 1027 / 918 - 1, 0.3, -0.1, 0.02)
    signed = {c: F.round(c, 6) + F.lit(0.0) for c in ("h_re", "h_im", "s_re", "s_im")}
    return rounded(out, 6, "r", "b").withColumns(signed | {"growth": F.round("growth", 7)}).select("iy", "ix", "r", "b", "growth", *signed)


@query(f"""WITH {GRID}, f AS (SELECT iy, ix, v / 100 AS vx, v / 250 * (ix + 1) / 50 AS vy FROM g),
s AS (SELECT iy, ix, (lead(vx) OVER x - lag(vx) OVER x) / 500 / 31557600 AS exx, (lead(vy) OVER y - lag(vy) OVER y) / 500 / 31557600 AS eyy, ((lead(vx) OVER y - lag(vx) OVER y) + (lead(vy) OVER x - lag(vy) OVER x)) / 1000 / 31557600 AS exy FROM f WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy))
SELECT iy, ix, round(log10(0.5 * pow(2e-25, -1 / 3.0) * pow(greatest(exx * exx + eyy * eyy + exx * eyy + exy * exy, 1e-24), -1 / 3.0)), 8) AS log_viscosity FROM s WHERE ix BETWEEN 1 AND 48 AND iy BETWEEN 1 AND 9""")
def viscosity_from_strain(spark, d):
    g = price_grid(spark, d).select("iy", "ix", (F.col("v") / 100).alias("vx"), (F.col("v") / 250 * (F.col("ix") + 1) / 50).alias("vy"))
    per_s = lambda v, along: grid.differentiate(g, v, along, 250.0) / S.SECONDS_PER_YEAR
    strain = g.select("iy", "ix", per_s("vx", "ix").alias("exx"), per_s("vy", "iy").alias("eyy"), ((per_s("vx", "iy") + per_s("vy", "ix")) / 2).alias("exy")).where("ix between 1 and 48 and iy between 1 and 9")
    return strain.select("iy", "ix", F.round(F.log10(plate.secant_viscosity(F.col("exx"), F.col("eyy"), F.col("exy"), 2e-25)), 8).alias("log_viscosity"))
