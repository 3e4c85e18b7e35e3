"""Closed forms of retracking and spectral filters."""

import numpy as np
from pyspark.sql import functions as F

from cellflow.operators import spectral, waveforms


def test_pchip_keeps_lines_and_never_overshoots(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0],), ([0.0, 0.0, 1.0, 5.0, 5.0],)], "y array<double>")
    line, steps = [np.array(r[0]) for r in rows.select(waveforms.monotone_cubic(F.col("y"), 10)).collect()]
    assert np.allclose(line, np.arange(41) / 10)
    assert np.allclose(steps[::10], [0, 0, 1, 5, 5]) and (np.diff(steps) >= -1e-12).all()


def test_retrackers_find_an_edge(spark):
    gate = np.arange(200)
    echo = (1 + 100 / (1 + np.exp(-(gate - 90.0) / 2)) * np.where(gate > 100, np.exp(-(gate - 100) / 10), 1)).tolist()
    rows = [(0, echo), (1, None), (2, []), (3, [1.0] * 200), (4, [float("nan")] * 200), (5, (1 + 0.5 * np.exp(-((gate - 100) ** 2) / 50.0)).tolist()), (6, (1 + 99.0 * (gate < 10)).tolist())]
    df = spark.createDataFrame(rows, "id int, w array<double>")
    out = {how: {r["id"]: r["r"] for r in df.select("id", waveforms.retrack(F.col("w"), how).alias("r")).collect()} for how in waveforms.RETRACKERS}
    assert abs(out["steepest"][0]["gate"] - 90) <= 0.6 and abs(out["half_power"][0]["gate"] - 90) <= 1.0 and out["centroid"][0]["status"] == "ok"
    assert all(out[how][i]["status"] == "empty" for how in out for i in (1, 2, 4))
    assert all(out[how][3]["status"] in ("flat", "low_snr", "peak_oob") and out[how][3]["gate"] is None for how in out) and out["steepest"][5]["status"] == "low_snr"


def test_filter_and_its_inverse(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 17))
    rows = [("f", iy, ix, float(a[iy, ix])) for iy in range(12) for ix in range(17)] + [("empty", 0, 0, None), ("empty", 0, 1, None)]
    grid = spark.createDataFrame(rows, "field string, iy int, ix int, v double")
    smooth = spectral.apply_multiplier(grid, "field", "v", 250.0, spectral.low_pass(200.0))
    back = spectral.apply_multiplier(smooth, "field", "v", 250.0, spectral.damped_inverse(spectral.low_pass(200.0), 0.0))
    got = {(r["iy"], r["ix"]): r["v"] for r in back.where("field = 'f'").collect()}
    assert max(abs(got[k] - a[k]) for k in got) < 1e-8 and len(got) == a.size
    assert [r["v"] for r in smooth.where("field = 'empty'").collect()] == [None, None]
    assert abs(np.mean([r["v"] for r in smooth.where("field = 'f'").collect()]) - a.mean()) < 1e-12
