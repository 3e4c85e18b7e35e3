"""Rasters, infill, divergence, control gates, paths in varying flow, caches and streams: closed forms and numpy versions."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellflow.operators import budget, gates, grid, spectral
from cellflow.sources import raster, readers, sinks
from cellflow.streaming import streams


def tiff(values, kind, compression=1, predictor=1, tile=None, order="<", nodata=None, strip_rows=3):
    """A small GeoTIFF by hand: strips or tiles of any sample kind."""
    a = np.asarray(values)
    h, w = a.shape
    bw, bh = tile or (w, strip_rows)
    blocks = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            part = np.zeros((bh if tile else min(bh, h - y), bw), a.dtype)
            cut = a[y : y + bh, x : x + bw]
            part[: cut.shape[0], : cut.shape[1]] = cut
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype)).astype(a.dtype)
            raw = part.astype(np.dtype(order + kind)).tobytes()
            if predictor == 3:
                planes = part.astype(np.dtype(">" + kind)).view(np.uint8).reshape(len(part), bw, -1).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(raw) if compression == 8 else raw)
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8 * a.dtype.itemsize]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind[0]]]), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0])]
    tags += [(322, 3, [bw]), (323, 3, [bh]), (324, 4, None), (325, 4, [len(b) for b in blocks])] if tile else [(278, 3, [bh]), (273, 4, None), (279, 4, [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, 2, f"{nodata}\0".encode()))
    tags.sort(key=lambda t: t[0])
    size = {3: "H", 4: "I", 12: "d"}
    begin = 8 + 2 + 12 * len(tags) + 4
    extra = sum(n for _, k, v in tags if (n := len(v) if k == 2 else struct.calcsize("=" + size[k]) * (len(blocks) if v is None else len(v))) > 4)
    offsets = np.cumsum([begin + extra, *[len(b) for b in blocks]])[:-1].tolist()
    table, more = b"", b""
    for tag, k, v in tags:
        v = offsets if v is None else v
        data = v if k == 2 else struct.pack(order + size[k] * len(v), *v)
        table += struct.pack(order + "HHI", tag, k, len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", begin + len(more)))
        more += data if len(data) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + table + b"\0" * 4 + more + b"".join(blocks)


CASES = [("f4", 1, 1, None, "<"), ("f8", 8, 1, None, ">"), ("i2", 8, 2, None, "<"), ("u1", 1, 1, (4, 4), "<"), ("f4", 8, 3, (16, 16), "<"), ("f4", 8, 3, None, ">"), ("i4", 8, 2, (8, 4), ">")]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_rasters_are_read(spark, tmp_path, case):
    kind, compression, predictor, tile, order = CASES[case]
    a = np.random.default_rng(case).integers(0, 120, (11, 18)).astype(kind)
    a[2, 3] = 99
    (tmp_path / "a.tif").write_bytes(tiff(a, kind, compression, predictor, tile, order, nodata=99))
    rows = raster.read_rasters(spark, [f"file://{tmp_path}/a.tif"]).collect()
    assert {(r.iy, r.ix): r.v for r in rows} == {(y, x): float(a[y, x]) for y in range(11) for x in range(18) if a[y, x] != 99}
    assert all((r.x, r.y) == (505.0 + 10 * r.ix, 895.0 - 10 * r.iy) for r in rows)


def test_raster_errors_and_round_trip(spark, tmp_path):
    (tmp_path / "lzw.tif").write_bytes(tiff(np.zeros((3, 3), "f4"), "f4", compression=5))
    with pytest.raises(Exception, match="compression 5 is not read"):
        raster.read_rasters(spark, [f"file://{tmp_path}/lzw.tif"]).collect()
    cells = spark.createDataFrame([("a", iy, ix, float(iy * 100 + ix) if (iy + ix) % 3 else None) for iy in range(70) for ix in range(30)], "k string, iy int, ix int, v double")
    written = raster.write_rasters(cells, f"file://{tmp_path}/out", "k", "v", (5.0, 700.0), 10.0, side=32)
    files = [r.file for r in written.collect()]
    back = {(int((700 - r.y) / 10), int((r.x - 5) / 10)): r.v for r in raster.read_rasters(spark, files).collect()}
    assert len(files) == 3 and back == {(r.iy, r.ix): r.v for r in cells.where("v is not null").collect()}


def test_infill_is_harmonic(spark):
    rng = np.random.default_rng(1)
    gap = rng.random((14, 17)) < 0.4
    gap[:3, :3] = True
    inside = np.ones((14, 17), bool)
    inside[6, :9] = inside[:7, 9] = False
    rows = [("f", y, x, None if gap[y, x] else 3.0 + 2 * x - y, bool(inside[y, x])) for y in range(14) for x in range(17)] + [("none", 0, 0, None, True)]
    out = {(r.field, r.iy, r.ix): r.v for r in grid.harmonic_infill(spark.createDataFrame(rows, "field string, iy int, ix int, v double, inside boolean"), "field", "v", "inside").collect()}
    assert out["none", 0, 0] is None and len(out) == inside.sum() + 1
    for y in range(14):
        for x in range(17):
            if inside[y, x]:
                near = [out["f", j, i] for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= j < 14 and 0 <= i < 17 and inside[j, i]]
                want = np.mean(near) if gap[y, x] else 3.0 + 2 * x - y
                assert abs(out["f", y, x] - want) < 1e-6


def test_spectral_divergence(spark):
    y, x = np.mgrid[0:32, 0:48]
    wave = np.pi / 48 / 100
    rows = [("f", int(a), int(b), float(np.sin(wave * 100 * (b + 0.5))), 0.0) for a, b in zip(y.ravel(), x.ravel(), strict=True)]
    df = spark.createDataFrame(rows, "field string, iy int, ix int, qx double, qy double")
    # Half a wave is mirrored into a corner; inside, the divergence is the cosine's.
    out = {(r.iy, r.ix): r.divergence for r in spectral.helmholtz_divergence(df, "field", "qx", "qy", 100.0, 0.0).collect()}
    assert max(abs(out[16, b] - wave * np.cos(wave * 100 * (b + 0.5))) for b in range(16, 32)) < 0.1 * wave
    noise = np.random.default_rng(2).normal(0, 0.02, (2, len(rows))).tolist()
    noisy = spark.createDataFrame([(*r[:3], None if r[1:3] == (5, 5) else r[3] + e, f) for r, e, f in zip(rows, *noise, strict=True)], df.schema)
    error = {}
    for length in (0.0, None):
        got = spectral.helmholtz_divergence(noisy, "field", "qx", "qy", 100.0, length).collect()
        assert [r.divergence for r in got if (r.iy, r.ix) == (5, 5)] == [None]
        error[length] = np.sqrt(np.mean([(r.divergence - wave * np.cos(wave * 100 * (r.ix + 0.5))) ** 2 for r in got if 8 <= r.ix < 40 and 8 <= r.iy < 24]))
    assert error[None] < 0.3 * error[0.0]
    plugged = grid.flux_divergence(df.selectExpr("iy", "ix", "1.0 AS H", "qx AS vx", "qy AS vy"), "H", "vx", "vy", 100.0, lambda g, step: spectral.helmholtz_divergence(g.withColumn("f", F.lit(1)), "f", "_fx", "_fy", step, 0.0))
    assert {(r.iy, r.ix): round(r.divergence, 12) for r in plugged.collect()} == {k: round(v, 12) for k, v in out.items()}


def test_control_gate_reasons(spark):
    site = spark.createDataFrame([(0, 0, 2, 5.0, 100.0), (0, 1, 2, 50.0, 100.0), (0, 2, 3, 1.0, 100.0), (0, 3, 2, None, 100.0)], "iy int, ix int, mask int, speed double, surface double")
    points = spark.createDataFrame([(1, 0.0, 0.0, 120.0, 0.1), (2, 0.0, 0.5, 100.0, 0.1), (3, 0.0, 1.0, 100.0, 1.0), (4, 0.0, 2.0, 100.0, 0.0), (5, 0.0, 0.0, 300.0, 0.0), (6, 0.0, 0.0, None, 0.0), (7, 9.0, 9.0, 1.0, 0.0), (8, 0.0, 3.0, 100.0, 0.0), (9, 0.0, 1.0, 100.0, None)], "id int, fy double, fx double, h double, dt_yr double")
    reasons = lambda **k: {r.id: r.reason for r in gates.control_gate(points, site, **k).collect()}
    assert reasons(budget=10.0) == {1: None, 2: None, 3: "speed", 4: "ground", 5: "residual", 6: "height", 7: "ground", 8: "speed", 9: "speed"}
    assert reasons()[2] == "speed" and reasons(residual=None)[5] is None


def shelf(spark, flow=None):
    x = np.arange(40) * 250.0
    h0 = np.tile(300 - 0.005 * x, (40, 1))
    row = {"start": 0, "H0": h0.ravel().tolist(), "vx": [200.0] * 1600, "vy": [0.0] * 1600, "div": [-1.0] * 1600, "a_dot": [0.0] * 1600, "partners": [(0.5, h0.ravel().tolist()), (1.0, h0.ravel().tolist())]}
    kinds = "start long, H0 array<double>, vx array<double>, vy array<double>, div array<double>, a_dot array<double>, partners array<struct<dt:double,H1:array<double>>>"
    if flow is None:
        return spark.createDataFrame([tuple(row.values())], kinds)
    return spark.createDataFrame([(*row.values(), flow)], kinds + ", flow array<struct<t:double,vx:array<double>,vy:array<double>>>")


def test_constant_flow_is_static_flow(spark):
    same = [(t, [200.0] * 1600, [0.0] * 1600) for t in (0.0, 0.4, 2.0)]
    run = lambda df: {(r.partner, r.iy, r.ix): r.mean for r in budget.lagrangian(df, (40, 40), 250.0).collect()}
    a, b = run(shelf(spark)), run(shelf(spark, same))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6
    # Flow that starts at rest and reaches 400 after a year: the mean of the first year is that of a steady 200.
    moving = run(shelf(spark, [(0.0, [0.0] * 1600, [0.0] * 1600), (1.0, [400.0] * 1600, [0.0] * 1600)]))
    assert moving.keys() <= a.keys() | {(1, y, x) for y in range(40) for x in range(40)} and moving != a


def test_origin_output(spark):
    df = shelf(spark)
    got = {(r.partner, r.iy, r.ix): (r.n, r.mean) for r in budget.lagrangian(df, (40, 40), 250.0, output="origin").collect()}
    # A parcel moves 200 m in the longer pair; those of the last column leave the grid and have no rate.
    assert all(ix < 39 or partner == 0 for partner, _, ix in got) and all(n == 1 for n, _ in got.values())
    # Ice that moves down a slope of 0.005 on a steady surface: -1 m a year along its way, and H div = -300 m a year to -250.
    for (partner, _, ix), (_, mean) in got.items():
        h = 300 - 0.005 * 250 * ix
        dt = (0.5, 1.0)[partner]
        steps = round(dt / 0.05)
        along = np.mean([h - 1.0 * 0.05 * (j + 1) for j in range(steps)])
        assert abs(mean - (-1.0 - along)) < 0.05
    with pytest.raises(ValueError):
        budget.lagrangian(df, (40, 40), 250.0, output="other")


def test_sinks_and_incremental_reads(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), {"a": 1, "b": [2]}, make).count() == 3
    assert len(made) == 1 and sinks.params_key({"a": 1, "b": 2}) == sinks.params_key({"b": 2, "a": 1})
    # A table whose writer was lost is made again; one that was whole and can't be read is an error.
    broken = tmp_path / "cache" / sinks.params_key({"c": 1})
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    assert sinks.cached(spark, str(tmp_path / "cache"), {"c": 1}, make).count() == 3 and len(made) == 2
    for part in broken.glob("*.parquet"):
        part.write_text("no parquet")
    for crc in broken.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        sinks.cached(spark, str(tmp_path / "cache"), {"c": 1}, make).count()
    assert len(made) == 2
    found, index = spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), spark.createDataFrame([("b",)], "name string")
    assert sorted(r.name for r in readers.only_new(found, index).collect()) == ["a", "c"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"dem_id": "x", "sources": ["is2", "cs2"]}, indent=1))
    (tmp_path / "j" / "b.json").write_text("{broken")
    rows = sorted(((r.dem_id, r.sources) for r in readers.json_sidecars(spark, str(tmp_path / "j"), "dem_id string, sources array<string>").collect()), key=str)
    assert rows == [("x", ["is2", "cs2"]), (None, None)] or rows == [(None, None), ("x", ["is2", "cs2"])]
    cells = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k int, d string, z double")
    sinks.write_cells(cells, str(tmp_path / "cells"), ["d"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "cells")).select("k", "d", "z").collect()) == [(1, "a", 2.0), (2, "b", 3.0)]
    sinks.write_control(spark.createDataFrame([(1.0, 2.0, 3.0)], "easting double, northing double, h_mean double"), str(tmp_path / "control"), source="is2")
    assert [tuple(r) for r in readers.control_csv(spark, str(tmp_path / "control")).collect()] == [(1.0, 2.0, 3.0)]


def test_bad_control_rows_are_errors(spark, tmp_path):
    (tmp_path / "c.csv").write_text("easting,northing,h_mean\n1,2,3\n4,x,6\n")
    with pytest.raises(Exception):
        readers.control_csv(spark, str(tmp_path / "c.csv")).collect()


def test_stream_reads_each_file_once(spark, tmp_path):
    args = (str(tmp_path / "in"), "k long", str(tmp_path / "out"), str(tmp_path / "state"))
    spark.range(3).withColumnRenamed("id", "k").write.parquet(args[0])
    for more in (0, 5):
        if more:
            spark.range(10, 10 + more).withColumnRenamed("id", "k").write.mode("append").parquet(args[0])
        streams.available_now(spark, *args)
        assert spark.read.parquet(args[2]).count() == 3 + more


@pytest.mark.parametrize("method", ["gradient", "cosine"])
def test_shift_is_recovered(spark, method):
    from cellflow.operators import shift
    from cellflow.operators.store import keep

    height = lambda x, y: 60 * np.sin(x / 300) + 50 * np.cos(y / 260) + 0.05 * x - 0.04 * y
    iy, ix = np.mgrid[0:50, 0:50]
    grid_rows = [(int(a), int(b), float(height(25.0 * b, 1225 - 25.0 * a))) for a, b in zip(iy.ravel(), ix.ravel(), strict=True)]
    rng = np.random.default_rng(4)
    x, y = rng.uniform(100, 1100, (2, 400))
    # The grid is 7 m east and 4 m south of the truth, and 1.5 m too high.
    z = height(x + 7, y - 4) - 1.5 + rng.normal(0, 0.1, 400)
    z[::40] += 25
    points = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "id int, x double, y double, z double")
    heights = spark.createDataFrame(grid_rows, "iy int, ix int, v double")
    out = shift.shift_to_points(heights, points, (0.0, 1225.0), 25.0, method, rounds=4, keep=keep)
    assert abs(out["dx"] - 7) < 0.5 and abs(out["dy"] + 4) < 0.5 and abs(out["dz"] - 1.5) < 0.2
    assert out["nmad_after"] < 0.5 * out["nmad_before"] and out["se_dx"] < 0.3
    if method == "gradient":
        flat = shift.shift_to_points(heights.withColumn("v", F.lit(1.0)), points, (0.0, 1225.0), 25.0, keep=keep)
        assert flat["dx"] is None and flat["rounds"] == 0


def test_series_are_smoothed(spark):
    from cellflow.operators import solvers

    rng = np.random.default_rng(7)
    t = np.sort(rng.uniform(0, 8, 60))
    truth = lambda t: 3 + 0.8 * t + 0.5 * np.sin(2 * np.pi * t)
    obs = [("a", float(u), float(truth(u) + rng.normal(0, 0.2)), 0.01) for u in t] + [("one", 1.0, 4.0, None), ("none", 1.0, None, None)]
    asked = [(k, float(u)) for k in ("a",) for u in np.linspace(0.5, 7.5, 30)] + [("one", 1.0), ("none", 2.0)]
    out = solvers.smooth_series(spark.createDataFrame(obs, "k string, t double, v double, alpha double"), spark.createDataFrame(asked, "k string, t double"), "k").collect()
    got = {(r.k, round(r.t, 9)): (r.mean, r["std"]) for r in out}
    error = [got["a", round(u, 9)][0] - truth(u) for _, u in asked[:30]]
    assert np.sqrt(np.mean(np.square(error))) < 0.15 and all(0 < got["a", round(u, 9)][1] < 1 for _, u in asked[:30])
    assert got["one", 1.0] == (4.0, 1.0) and got["none", 2.0] == (None, None)
    # Without noise to speak of, a line is followed exactly, between its values too.
    line = spark.createDataFrame([("b", float(u), 2.0 * u, 0.0) for u in range(6)], "k string, t double, v double, alpha double")
    mid = solvers.smooth_series(line, spark.createDataFrame([("b", 2.5)], "k string, t double"), "k", season=False, floor=1e-4).first()
    assert abs(mid["mean"] - 5.0) < 1e-3


def test_common_epoch_mean_smooths_slopes(spark):
    from cellflow.functions.scalars import SECONDS_PER_YEAR

    year = SECONDS_PER_YEAR
    rows = [(0, x, k * year, 10.0 + x + 2.0 * k) for x in range(9) for k in range(5) if not (x == 4 and k > 1)]
    cells = spark.createDataFrame(rows, "iy int, ix int, t double, z double")
    slopes = spark.createDataFrame([(0, x, None if x == 4 else 2.0) for x in range(9)], "iy int, ix int, slope double")
    out = {r.ix: r["mean"] for r in gates.common_epoch_mean(cells, slopes, ["iy", "ix"], "t", "z", sigma=1.0).collect()}
    assert all(abs(out[x] - (14.0 + x)) < 1e-9 for x in range(9))
    plain = {r.ix: r["mean"] for r in gates.common_epoch_mean(cells, slopes, ["iy", "ix"], "t", "z").collect()}
    assert plain[4] == 15.0 and plain[3] == 17.0


def test_parcel_lines(spark):
    """A uniform sheet that stretches, takes snow and melts at a constant rate: the line's slope is the rate, blunders or not."""
    n, a, b, e = 12, 0.4, -3.0, 0.05
    times = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    tau = lambda t: (np.exp(e * t) - 1) / e
    heights = [[float((400 + (a + b) * tau(t)) / np.exp(e * t))] * (n * n) for t in times]
    heights[3][5 * n + 5] = 900.0
    flat = lambda v: [v] * (n * n)
    kinds = "tile long, times array<double>, H array<array<double>>, vx array<double>, vy array<double>, div array<double>, a_dot array<double>"
    tiles = spark.createDataFrame([(7, times, heights, flat(50.0), flat(0.0), flat(e), flat(a))], kinds)
    out = {(r.iy, r.ix): r for r in budget.parcel_rates(tiles, (n, n), 250.0).collect()}
    assert all(abs(r.rate - b) < 0.01 and r.tile == 7 for r in out.values()) and out[2, 2].n == 6 and out[2, 2].span == 2.5
    plain = {(r.iy, r.ix): r.rate for r in budget.parcel_rates(tiles, (n, n), 250.0, rounds=0).collect()}
    assert abs(plain[5, 5] - b) > 1 and abs(plain[2, 2] - b) < 0.01
    assert budget.parcel_rates(tiles, (n, n), 250.0, min_span=5.0).count() == 0


def test_space_time_modes(spark):
    from cellflow.operators import solvers

    rng = np.random.default_rng(12)
    t = np.arange(10) / 2
    x = np.outer(np.sin(t), rng.normal(size=30)) * 3 + np.outer(t, rng.normal(size=30)) + rng.normal(0, 0.05, (10, 30)) + rng.normal(size=30) * 10
    rows = [(c, float(t[e]), float(x[e, c])) for e in range(10) for c in range(30)] + [(99, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "cell int, epoch double, v double")
    coefficients, modes, shares = solvers.space_time_modes(df, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = {(r.epoch, r.mode): r.coefficient for r in coefficients.collect()}
    on = {(r.cell, r.mode): r.value for r in modes.collect()}
    for k in range(2):
        sign = np.sign(vt[k, 0])
        assert np.allclose([got[float(v), k] for v in t], sign * u[:, k] * s[k]) and np.allclose([on[c, k] for c in range(30)], sign * vt[k])
    assert np.allclose(shares, (s[:2] ** 2) / (s**2).sum()) and (99, 0) not in on
    field = {(r.cell, r.t): r.v for r in solvers.fused_field(df.where("cell < 99"), [1.0, 1.25], 2, season=False).collect()}
    truth = {c: (x[2, c], (x[2, c] + x[3, c]) / 2) for c in range(30)}
    assert np.sqrt(np.mean([(field[c, 1.0] - truth[c][0]) ** 2 for c in range(30)])) < 0.4 and np.sqrt(np.mean([(field[c, 1.25] - truth[c][1]) ** 2 for c in range(30)])) < 0.6


def test_melt_behind_a_surface(spark):
    from cellflow.operators import plate

    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:20, 0:24]
    melt = -5 * np.exp(-((y - 9) ** 2 + (x - 12) ** 2) / 20.0) + rng.normal(0, 0.01, (20, 24))
    rows = [("f", int(a), int(b), float(melt[a, b])) for a, b in zip(y.ravel(), x.ravel(), strict=True)]
    grid_of = spark.createDataFrame(rows, "field string, iy int, ix int, v double")
    response = plate.steady_multiplier(300.0, 1027 / 918 - 1, 0.2, 0.0, 0.01)
    waves = plate.steady_state(plate.wavenumbers(spark, 6, 8, 700.0), 300.0, 1027 / 918 - 1, 0.2, 0.0, 0.01).collect()
    for part, re, im in (("surface", "h_re", "h_im"), ("base", "s_re", "s_im")):
        m = plate.steady_multiplier(300.0, 1027 / 918 - 1, 0.2, 0.0, 0.01, part)
        assert all(abs(complex(m(np.array([r.ky]), np.array([r.kx]))[0]) - complex(r[re], r[im])) < 1e-6 for r in waves)
    surface = spectral.apply_multiplier(grid_of, "field", "v", 700.0, response)
    back = spectral.apply_multiplier(surface, "field", "v", 700.0, spectral.damped_inverse(response, 1e-9))
    assert max(abs(r.v - melt[r.iy, r.ix]) for r in back.collect()) < 0.3


def test_difference_files_and_logs(spark, tmp_path):
    d = tmp_path / "diff"
    d.mkdir()
    (d / "a.csv").write_text("# Max difference:       3.5\n# Median difference:   1.0\n# Mean difference: 0.9\n-100.0,-75.0,1.5\n-100.1,-75.1,0.25\nbad,row,x\n-100.2,-75.2,3.5\n")
    (d / "b.csv").write_text("1,2,4\n3,4,6\n")
    (d / "c.csv").write_text("# Min difference: -1\n")
    out = {r.file[-5]: r for r in readers.difference_summary(spark, str(d)).collect()}
    assert (out["a"]["max"], out["a"]["median"], out["a"].n, out["a"].mad) == (3.5, 1.0, 3, 0.75) and abs(out["a"].rmse - np.sqrt((1.5**2 + 0.25**2 + 3.5**2) / 3)) < 1e-12
    assert (out["b"]["median"], out["b"].n, out["b"].mad, out["b"]["max"]) == (5.0, 2, 1.0, None) and (out["c"]["min"], out["c"].n, out["c"].mad) == (-1.0, 0, None)
    for name, text in (("s1-log-align-01.txt", "Translation vector magnitude (meters): 9"), ("s1-log-align-02.txt", "x\nTranslation vector magnitude (meters): 2.6391508\n"), ("s2-log-align-01.txt", "nothing")):
        (tmp_path / name).write_text(text)
    files = spark.createDataFrame([(f"{tmp_path}/{p.name}",) for p in tmp_path.glob("*.txt")], "file string")
    last = {r.run.rsplit("/", 1)[1]: r.file for r in readers.latest_logs(files).collect()}
    assert last["s1"].endswith("02.txt") and readers.log_magnitude(spark, last["s1"]).first().metres == 2.6391508 and readers.log_magnitude(spark, last["s2"]).first().metres is None
    head = spark.createDataFrame([(1, '<Start_Lat unit="10-6 deg">-75123456</Start_Lat> Stop_Lat=-74000000'), (2, "Stop_Lat=1")], "id int, t string")
    got = {r.id: r.s for r in head.select("id", readers.header_segment(F.col("t"), {"start": "Start_Lat", "stop": "Stop_Lat"}).alias("s")).collect()}
    assert abs(got[1].start + 75.123456) < 1e-9 and got[1].stop == -74.0 and got[2] is None


def test_axes_and_lonlat_grid(spark):
    assert readers.axes(0.0, 1000.0, -500.0, 0.0, 250.0) == (2, 4, 0.0, 0.0) and readers.axes(0.0, 1001.0, 0.0, 1.0, 250.0)[:2] == (1, 5)
    points = spark.createDataFrame([(10.0 + 0.5 * x, -70.0 - y, float(10 * y + x)) for y in range(3) for x in range(4)], "lon double, lat double, v double")
    cells = {(r.iy, r.ix): r.v for r in readers.lonlat_grid(points, "v").collect()}
    assert cells == {(2 - y, x): float(10 * y + x) for y in range(3) for x in range(4)}
    with pytest.raises(ValueError):
        readers.lonlat_grid(points.where("v <> 11"), "v")
