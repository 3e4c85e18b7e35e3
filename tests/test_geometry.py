"""Closed forms and edge cases of the geometry, plate and rank operators."""

import math
import random
import statistics

from pyspark.sql import functions as F

from cellflow.functions import corrections, names, scalars
from cellflow.operators import footprints, plate, stats


def test_median_of_all(spark):
    rng = random.Random(5)
    for values in ([], [None], [3.0], [1.0, 1.0, 1.0, 2.0], [rng.gauss(0, 10 ** rng.randint(-9, 9)) for _ in range(501)] + [None, 7.0], [math.inf * 0 + 1e300, -1e300, 5e-324, 0.0]):
        values = [v for v in values if v is None or not math.isnan(v)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None]
        assert stats.median_of_all(df, "v") == (statistics.median(known) if known else None)


def test_plane_is_recovered(spark):
    rows = [("a", float(x), float(y), 5 + 0.3 * x - 0.2 * y) for x in range(6) for y in range(5)] + [("line", float(x), 2.0 * x, 1.0) for x in range(9)] + [("few", 1.0, 2.0, 3.0), ("a", None, 1.0, 1.0)]
    out = {r["k"]: r for r in stats.plane(spark.createDataFrame(rows, "k string, x double, y double, z double"), ["k"], "x", "y", "z").collect()}
    assert abs(out["a"]["ax"] - 0.3) < 1e-12 and abs(out["a"]["ay"] + 0.2) < 1e-12 and out["a"]["sd"] < 1e-6 and out["a"]["n"] == 30
    assert out["line"]["ax"] is None and out["few"]["sd"] is None


def test_boxes(spark):
    rng = random.Random(3)
    box = lambda i: (i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.choice([0, 1, 30]), y + rng.choice([0, 2, 25]))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    frames = [spark.createDataFrame(t, "id long, x0 double, y0 double, x1 double, y1 double") for t in (a, b)]
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted(tuple(r) for r in footprints.overlapping(*frames, 7.0).collect()) == want
    assert footprints.overlapping(frames[0].limit(0), frames[1], 7.0).count() == 0


def test_inside_and_null(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(footprints.inside(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]


def test_plate_limits(spark):
    """Long waves float: base and surface move as 1 to -1 / delta without extension; without relaxation floor short waves hardly move."""
    delta = 1027 / 918 - 1
    waves = spark.createDataFrame([(0.0, 0.0), (0.05, 0.0), (5.0, 0.0)], "kx double, ky double")
    dc, long, short = plate.steady_state(waves, 1.0, delta).orderBy("kx").collect()
    assert abs(dc["h_re"] + 2) < 1e-9 and abs(dc["s_re"] - 2 / delta) < 1e-9 and abs(long["h_re"] / dc["h_re"] - 1) < 0.02
    assert all(r["growth"] < 0 for r in (dc, long, short)) and abs(short["h_re"]) < abs(long["h_re"])
    q = complex(0, 2.0) - 0.1
    got = plate.steady_state(spark.createDataFrame([(1.0, 0.0)], "kx double, ky double"), 2.0, delta, along=1.0, stretch=0.1).first()
    below = delta * (got["r"] ** 2 - got["b"] ** 2) + q * (delta + 1) * got["r"] + q * q
    assert abs(complex(got["h_re"], got["h_im"]) + delta * got["b"] / below) < 1e-12 and abs(complex(got["s_re"], got["s_im"]) - (got["r"] + q) / below) < 1e-12


def test_names(spark):
    df = spark.createDataFrame([("SET_20190203_x",), ("no date",), ("a_20191399_b",), (None,)], "n string")
    assert [str(r[0]) for r in df.select(names.date_in_name(F.col("n"))).collect()] == ["2019-02-03", "None", "None", "None"]
    assert [r[0] for r in spark.createDataFrame([(" Ab ",), ("__x",), ("",), (None,)], "s string").select(names.canonical_suffix(F.col("s"))).collect()] == ["_ab", "_x", "", None]


def test_lonlat_near_pole(spark):
    df = spark.createDataFrame([(-179.5, -89.9), (0.0, -60.5), (90.0, -75.0)], "lon double, lat double")
    there = df.select("lon", "lat", *[c.alias(n) for c, n in zip(scalars.polar_stereographic(F.col("lon"), F.col("lat")), "xy", strict=True)])
    lon, lat = corrections.lonlat(F.col("x"), F.col("y"))
    assert all(abs(r["lon"] - r["a"]) < 1e-8 and abs(r["lat"] - r["b"]) < 1e-8 for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect())


def test_robust_plane_leaves_out_blunders(spark):
    from cellflow.operators.store import keep

    rng = random.Random(9)
    places = [(rng.uniform(0, 100), rng.uniform(0, 80)) for _ in range(200)]
    rows = [("a", x, y, 5 + 0.3 * x - 0.2 * y + rng.gauss(0, 0.1) + (400 if k % 10 == 0 else 0)) for k, (x, y) in enumerate(places)]
    rows += [("few", 1.0, 2.0, 3.0), ("few", None, 1.0, 1.0)] + [("line", float(k), 2.0 * k, 1.0) for k in range(40)]
    out = {r["k"]: r for r in stats.robust_plane(spark.createDataFrame(rows, "k string, x double, y double, z double"), ["k"], "x", "y", "z", keep).collect()}
    a = out["a"]
    assert abs(a["ax"] - 0.3) < 0.005 and abs(a["ay"] + 0.2) < 0.005 and abs(a["offset"] - (5 + 0.3 * a["xc"] - 0.2 * a["yc"])) < 0.1 and 0.05 < a["sd"] < 0.2 and 0 < a["se_ax"] < 0.002
    assert out["few"]["ax"] is None and out["few"]["n"] == 1 and out["line"]["ax"] is None and out["line"]["n"] == 40


def test_clipped_line(spark):
    rows = [("a", float(i), 2.0 * i + 1 + (500 if i == 7 else 0)) for i in range(30)] + [("few", 1.0, 2.0), ("none", None, 1.0)]
    out = {r["k"]: r for r in stats.clipped_line(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert out["a"]["n"] == 29 and abs(out["a"]["slope"] - 2) < 1e-9 and abs(out["a"]["intercept"] - 1) < 1e-9 and out["a"]["mad"] < 1e-9
    assert out["few"]["n"] == 1 and out["few"]["slope"] is None and "none" not in out


def test_flotation_transfer(spark):
    """Long waves float; the ratio of responses as complex numbers."""
    from cellflow.operators import plate

    delta = 1027 / 918 - 1
    rows = plate.flotation_transfer(plate.steady_state(plate.wavenumbers(spark, 9, 12, 3000.0), 400.0, delta, 0.3, -0.1), delta).collect()
    for r in rows:
        if r.kx == r.ky == 0:
            assert (r.t_re, r.t_im) == (1.0, 0.0)
        else:
            want = (r.h_re + 1j * r.h_im) / (delta / (1 + delta) * ((r.h_re - r.s_re) + 1j * (r.h_im - r.s_im)))
            assert abs(r.t_re + 1j * r.t_im - want) < 1e-9
    longest = min((r for r in rows if r.kx or r.ky), key=lambda r: r.kx**2 + r.ky**2)
    assert abs(longest.t_re + 1j * longest.t_im - 1) < 0.1


def test_overlaps_are_counted_without_pairs(spark, monkeypatch):
    """As brute force, with ties on edges, with cells of few rows, and partners found by looking through ids or by the join."""
    from cellflow.operators.store import keep

    rng = random.Random(8)
    corner = lambda: rng.choice([float(rng.randint(-6, 6)), rng.uniform(-6, 6)])
    box = lambda i: (i, x := corner(), y := corner(), x + rng.choice([0.0, 0.5, 3.0]), y + rng.choice([0.0, 1.0, 9.0]))
    a, b = [box(i) for i in range(300)] + [box(7), (500, 90.0, 90.0, 91.0, 91.0), (501, None, 0.0, 1.0, 1.0)], [box(10_000 - i) for i in range(400)] + [(3, 0.0, None, 1.0, 1.0)]
    frames = [spark.createDataFrame(t, "id long, x0 double, y0 double, x1 double, y1 double") for t in (a, b)]
    want = {}
    for p in a:
        hit = [q[0] for q in b if None not in (*p, *q) and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
        if hit:
            n, first = want.get(p[0], (0, math.inf))
            want[p[0]] = n + len(hit), min(first, *hit, 10**9)
    for name, cell, look, left in (("few", 20, 150, 0), ("join", 50, 100, 10**6)):
        monkeypatch.setattr(footprints, "CELL", cell), monkeypatch.setattr(footprints, "LOOK", look), monkeypatch.setattr(footprints, "LEFT", left)
        assert {r["id"]: (r["n"], r["first"]) for r in footprints.overlap_counts(*frames, 2.0, keep).collect()} == want, name
    assert footprints.overlap_counts(frames[0].limit(0), frames[1], 2.0, keep).count() == 0
