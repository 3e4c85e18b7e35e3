"""Closed forms and numpy versions of binning, variograms, the tilt fit, pair biases and retracking."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellflow.operators import joins, qc, solvers, spatial, stats, waveforms
from cellflow.operators.store import keep


def test_binning_drops_rows_outside_any_variable(spark):
    df = spark.createDataFrame([(1.0, 0.5, 10.0), (1.5, 9.0, 1000.0), (3.0, 0.7, 20.0), (2.0, 1.0, 30.0), (None, 0.5, 5.0), (1.0, 0.5, None)], "a double, b double, v double")
    out = {(r["nd"], r["a_bin"], r["b_bin"]): r for r in stats.nd_binning(df, {"a": [1, 2, 3], "b": [0, 1]}, "v", min_count=2).collect()}
    # The row with b = 9 counts in no marginal of a; upper edges belong to the last bins.
    assert {k: r["count"] for k, r in out.items()} == {(1, 0, None): 1, (1, 1, None): 2, (1, None, 0): 3, (2, 0, 0): 1, (2, 1, 0): 2}
    assert out[1, 0, None]["nmad"] is None and abs(out[1, 1, None]["nmad"] - 1.4826 * 5) < 1e-9 and out[1, 1, None]["a_mid"] == 2.5
    assert stats.nd_binning(df.limit(0), {"a": [1, 2], "b": [0, 1]}, "v").count() == 0


def test_quantile_edges_and_dispersion(spark):
    rng = np.random.default_rng(3)
    n = 6_000
    count, rmse = rng.integers(2, 40, n).astype(float), rng.uniform(0.5, 5, n)
    v = rng.normal(size=n) * (0.3 + 0.2 * rmse + 2 / np.sqrt(count))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(count, rmse, v, strict=True)], "n double, rmse double, v double")
    assert np.allclose(stats.quantile_edges(df, "rmse", 4), np.quantile(rmse, [0, 0.25, 0.5, 0.75, 1]))
    by = {"n": [2, 5, 10, 20, 39], "rmse": [0.5, 1.5, 3, 5.0]}
    out, _, scale = stats.heteroscedasticity(df, by, "v")
    rows = out.collect()
    z = np.array([r["standard"] for r in rows])
    assert abs(1.4826 * np.median(np.abs(z - np.median(z))) - 1) < 1e-9 and 0.9 < scale < 1.1
    ratio = np.array([r["sigma"] / (0.3 + 0.2 * r["rmse"] + 2 / np.sqrt(r["n"])) for r in rows if 4 < r["n"] < 30 and 1 < r["rmse"] < 4])
    assert abs(np.median(ratio) - 1) < 0.1


def test_ranks_and_medians_without_one_task(spark):
    v = [3.0, 1.0, 2.0, 2.0, None, 5.0, -1.0, 2.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id int, v double")
    got = {r["id"]: r["r"] for r in stats.ranked(df.repartition(3), "v", "r", keep).collect()}
    known = [x for x in v if x is not None]
    assert got == {k: None if x is None else 1 + sum(y < x for y in known) for k, x in enumerate(v)}
    assert stats.quantiles_of_all(df, "v", [0.0, 0.3, 0.5, 1.0]) == pytest.approx(np.quantile(known, [0, 0.3, 0.5, 1]).tolist())


def test_collocation_is_a_disc(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10.0), (2, 50.0, 50.0, 0.0, 4.0)], "id int, x double, y double, t double, h double")
    right = spark.createDataFrame([(3.0, 4.0, 60.0, 7.0), (4.0, 4.0, 0.0, 99.0), (0.0, -5.0, -60.0, 9.0), (0.0, 1.0, 61.0, 50.0), (-5.0, 0.0, 0.0, 8.0)], "x double, y double, t double, h double")
    assert [tuple(r) for r in joins.collocate(left, right, 5.0, 60.0).collect()] == [(1, 10.0, 8.0, 3, 2.0)]
    assert joins.collocate(left, right, 5.0, 60.0, 4).count() == 0


def test_min_extent_keeps_what_was_never_observed(spark):
    cells = spark.createDataFrame([(1, 30.0), (1, 2.0), (2, 1.0), (2, 2.0), (3, None), (5, 1.0), (5, 1.0)], "k int, z double")
    floating = spark.createDataFrame([(1,), (2,), (3,), (4,), (6,)], "k int")
    assert sorted(r.k for r in qc.min_extent(cells, floating, ["k"], "z").collect()) == [1, 3, 4, 6]
    assert sorted(r.k for r in qc.min_extent(cells, floating, ["k"], "z", extent=spark.createDataFrame([(1,), (2,), (4,)], "k int")).collect()) == [1, 4]


@pytest.mark.parametrize("how", ["matheron", "dowd"])
def test_variogram_as_numpy(spark, how):
    rng = np.random.default_rng(2)
    x, y, v = rng.uniform(0, 10, (3, 150))
    edges = [0.0, 1.0, 2.0, 4.0]
    d = np.hypot(x[:, None] - x, y[:, None] - y)[np.triu_indices(150, 1)]
    dv = (v[:, None] - v)[np.triu_indices(150, 1)]
    out = {r["bin"]: (r["n"], r["gamma"], r["lag"]) for r in spatial.variogram(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(zip(x, y, v, strict=True))], "id int, x double, y double, v double"), edges, how).collect()}
    for k, (a, b) in enumerate(itertools.pairwise(edges)):
        in_bin = dv[(d >= a) & (d < b)]
        gamma = (in_bin**2).mean() / 2 if how == "matheron" else (1.4826 * np.median(np.abs(in_bin))) ** 2 / 2
        assert out[k] == (len(in_bin), pytest.approx(gamma), (a + b) / 2)


def test_models_are_found_again(spark):
    h = np.geomspace(20, 9000, 25)
    true = [("nugget", 0.06, 0.0), ("spherical", 0.19, 4100.0)]
    fit = spatial.fit_model(h, spatial.model_value(h, true), np.full(25, 500), ("nugget", "spherical"))
    assert fit["total_sill"] == pytest.approx(0.25, rel=1e-3) and fit["ranges"][0] == pytest.approx(4100, rel=1e-2) and fit["r2"] > 0.9999
    two = [("nugget", 0.05, 0.0), ("exponential", 0.1, 300.0), ("gaussian", 0.2, 5000.0)]
    again = spatial.fit_model(h, spatial.model_value(h, two), None, ("nugget", "exponential", "gaussian"))
    assert again["r2"] > 0.999 and again["total_sill"] == pytest.approx(0.35, rel=0.03)
    column = spark.createDataFrame([(float(x),) for x in [0.0, *h]], "h double").select(spatial.model_column(F.col("h"), two).alias("g"), spatial.covariance(F.col("h"), two).alias("c")).collect()
    assert np.allclose([r["g"] for r in column], spatial.model_value(np.array([0.0, *h]), two)) and column[0]["c"] == pytest.approx(0.35)


def test_effective_samples_limits(spark):
    p = spark.createDataFrame([(float(a), float(b)) for a in range(20) for b in range(20)], "x double, y double")
    assert spatial.effective_samples(p, [("nugget", 1.0, 0.0)])["n_eff"] == pytest.approx(400)
    assert spatial.effective_samples(p, [("spherical", 1.0, 1e9)])["n_eff"] == pytest.approx(1, abs=1e-3)
    sampled = spatial.effective_samples(p, [("spherical", 1.0, 8.0)], sample=200, draws=4)["n_eff"]
    assert sampled == pytest.approx(spatial.effective_samples(p, [("spherical", 1.0, 8.0)])["n_eff"], rel=0.25)
    assert spatial.effective_samples(p.limit(1), [("spherical", 2.0, 8.0)])["var_mean"] == 2.0
    with pytest.raises(ValueError):
        spatial.effective_samples(p.limit(0), [("nugget", 1.0, 0.0)])


def test_tilts_are_recovered(spark):
    tilt = [(1e-4, 5e-5, 0.5), (-1e-4, -5e-5, -0.5), (5e-5, 5e-5, 0.3), (-5e-5, -5e-5, -0.3)]
    rows = [(20 * i + j, k, 365.25 * k / 2, 250.0 * j, -250.0 * i, 100 + dx * 250 * j - dy * 250 * i + dz) for i in range(20) for j in range(20) for k, (dx, dy, dz) in enumerate(tilt)]
    df = spark.createDataFrame(rows, "cell int, epoch int, t double, x double, y double, z double")
    weak = {"level_sd": 1e3, "slope_sd": 1e-6, "tilt_sd": (1e-2, 1e-2), "offset_sd": 1e2}
    epochs, trends = solvers.tilt_fit(df, keep, **weak, robust=False)
    e = {r["epoch"]: r for r in epochs.collect()}
    for a, b in itertools.combinations(range(4), 2):
        assert e[a]["tilt_dx"] - e[b]["tilt_dx"] == pytest.approx(tilt[a][0] - tilt[b][0], abs=1e-6)
        assert e[a]["tilt_dy"] - e[b]["tilt_dy"] == pytest.approx(tilt[a][1] - tilt[b][1], abs=1e-6)
    left = solvers.untilted(df, epochs).groupBy("cell").agg((F.max("z") - F.min("z")).alias("spread")).agg(F.max("spread")).first()[0]
    assert left < 0.05 and trends.count() == 400 and sum(r["tilt_dz"] for r in e.values()) == pytest.approx(0, abs=1e-9)


def test_tilt_fit_as_dense_least_squares_and_robust(spark):
    rng = np.random.default_rng(5)
    rows = [(c, k, 100.0 * k, float(c % 5) * 100, float(c // 5) * 100, 50 + c + 0.001 * k + 0.01 * (c % 5) * k + rng.normal() * 0.1) for c in range(25) for k in range(5) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "cell int, epoch int, t double, x double, y double, z double")
    prior = {"level_sd": 5.0, "slope_sd": 0.01, "tilt_sd": (1e-3, 2e-3), "offset_sd": 0.5}
    epochs, trends = solvers.tilt_fit(df, keep, **prior, robust=False)
    mid = {c: np.median([r[5] for r in rows if r[0] == c]) for c in range(25)}
    ref = {k: (np.mean([r[3] for r in rows if r[1] == k]), np.mean([r[4] for r in rows if r[1] == k])) for k in range(5)}
    a, z = np.zeros((len(rows), 65)), np.array([r[5] - mid[r[0]] for r in rows])
    for i, (c, k, t, x, y, _) in enumerate(rows):
        a[i, c], a[i, 25 + c], a[i, 50 + 3 * k : 53 + 3 * k] = 1, t - 200, [x - ref[k][0], y - ref[k][1], 1]
    sd = np.array([5.0] * 25 + [0.01] * 25 + [1e-3, 2e-3, 0.5] * 5)
    want = np.linalg.lstsq(np.vstack([a, np.diag(1 / sd)]), np.concatenate([z, np.zeros(65)]), rcond=None)[0]
    shift = want[52::3].mean()
    for r in epochs.collect():
        k = 50 + 3 * r["epoch"]
        assert (r["tilt_dx"], r["tilt_dy"], r["tilt_dz"]) == pytest.approx((want[k], want[k + 1], want[k + 2] - shift), abs=1e-9)
    for r in trends.collect():
        assert (r["intercept"], r["dhdt"]) == pytest.approx((want[r["cell"]] + mid[r["cell"]] + shift, want[25 + r["cell"]]), abs=1e-8)
    bad = spark.createDataFrame([(c, k, t, x, y, z + (80.0 if c == 3 and k == 2 else 0.0)) for c, k, t, x, y, z in rows], df.schema)
    robust, _ = solvers.tilt_fit(bad, keep, **prior, rounds=4)
    plain = {r["epoch"]: r["tilt_dz"] for r in epochs.collect()}
    assert all(abs(r["tilt_dz"] - plain[r["epoch"]]) < 0.1 for r in robust.collect()) and min(r["weight_frac_kept"] for r in robust.collect()) < 1


def test_pair_biases(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=12)
    k = np.arange(12) - 5.5
    s -= s.mean()
    s -= k * (k @ s) / (k @ k)
    rows = [(i, j, (j - i) * 0.5, float(-8 + (s[j] - s[i]) / ((j - i) * 0.5) + rng.normal() * 0.02), 300) for i in range(12) for j in range(i + 1, 12)]
    rows[7] = (*rows[7][:3], 10.0, 300)
    mu, biases, told = solvers.pair_epoch_bias(spark.createDataFrame(rows, "i int, j int, dt_yr double, value double, n int"), rounds=40, ridge=1e-3)
    assert mu == pytest.approx(-8, abs=0.1) and all(abs(r["s"] - s[r["epoch"]]) < 0.1 for r in biases.collect())
    assert [(r["i"], r["j"]) for r in told.where("abs(resid) > 10").collect()] == [rows[7][:2]] and told.where("abs(resid) > 10 and weight > 0").count() == 0


def test_empty_solvers(spark):
    none = spark.createDataFrame([], "id int, v array<double>")
    assert solvers.kmeans(none, "id", "v", 3).count() == 0 and len(solvers.principal_components(none, "v", 2)[0]) == 0


def numpy_echo(w, limits, foot, share=None):
    """The published steps in numpy: moving mean, noise, first return, foot of the edge, dense monotone cubic, steepest place or crossing."""
    w = np.convolve(w, np.full(limits.smooth, 1 / limits.smooth), "same")
    head = w[: limits.early]
    noise = head[head <= np.median(head)].mean()
    over = [i for i in range(1, len(w) - 1) if w[i] >= noise + limits.first * (w.max() - noise) and w[i] >= w[i - 1] and w[i] >= w[i + 1]]
    peak = over[0] if w.max() > noise and over else int(w.argmax())
    if w[peak] <= noise:
        return "flat", None
    if not limits.margin <= peak <= len(w) - limits.margin:
        return "peak_oob", None
    if w[peak] / max(noise, 1e-6) < limits.snr:
        return "low_snr", None
    low = [i for i in range(peak) if w[i] <= noise + foot * (w[peak] - noise)]
    edge = low[-1] if low else 0
    if peak - edge < 2:
        return "short_le", None
    y, d = w[edge : peak + 1], np.diff(w[edge : peak + 1])
    m = [0.0] * len(y)
    for k in range(1, len(y) - 1):
        m[k] = 2 / (1 / d[k - 1] + 1 / d[k]) if d[k - 1] * d[k] > 0 else 0.0
    for k, near, far in ((0, d[0], d[1]), (len(y) - 1, d[-1], d[-2])):
        e = (3 * near - far) / 2
        m[k] = 0.0 if e * near <= 0 else 3 * near if near * far < 0 and abs(e) > 3 * abs(near) else e
    fine = []
    for j in range(10 * (len(y) - 1) + 1):
        k = min(j // 10, len(y) - 2)
        u = j / 10 - k
        fine.append(np.dot([2 * u**3 - 3 * u**2 + 1, u**3 - 2 * u**2 + u, 3 * u**2 - 2 * u**3, u**3 - u**2], [y[k], m[k], y[k + 1], m[k + 1]]))
    if share is None:
        return "ok", edge + int(np.gradient(fine).argmax()) / 10
    hit = [j for j, x in enumerate(fine) if x >= noise + share * (w[peak] - noise)]
    return ("ok", edge + hit[0] / 10) if hit else ("no_cross", None)


def test_retrackers_as_numpy(spark):
    rng, gate = np.random.default_rng(6), np.arange(160)
    rows = []
    for k in range(60):
        rise, height = rng.uniform(30, 140), rng.uniform(0, 60)
        w = rng.uniform(0.5, 1.5, 160) + height / (1 + np.exp(-(gate - rise) / rng.uniform(0.5, 4))) * np.where(gate > rise + 8, np.exp(-(gate - rise - 8) / 15), 1)
        rows.append((k, w.tolist()))
    limits = waveforms.Limits(early=25, snr=5.0, margin=40)
    df = spark.createDataFrame(rows, "id int, w array<double>").select("id", *[waveforms.retrack(F.col("w"), how, limits).alias(how) for how in ("steepest", "half_power")])
    seen = set()
    for r in df.collect():
        for how, foot, share in (("steepest", 0.05, None), ("half_power", 0.01, 0.5)):
            status, at = numpy_echo(np.array(rows[r["id"]][1]), limits, foot, share)
            seen.add(status)
            assert r[how]["status"] == status and (at is None) == (r[how]["gate"] is None), (r, status, at)
            assert at is None or abs(r[how]["gate"] - at) < 0.11
    assert {"ok", "peak_oob", "low_snr"} <= seen


def test_coherent_return_is_chosen(spark):
    gate = np.arange(200)
    bump = lambda at, h: h * np.exp(-((gate - at) ** 2) / 18.0)
    w = (1 + bump(80, 40) + bump(120, 100)).tolist()
    late, early = np.where(abs(gate - 120) < 15, 0.95, 0.2).tolist(), np.where(abs(gate - 80) < 15, 0.95, 0.2).tolist()
    df = spark.createDataFrame([(1, w, early), (2, w, late), (3, w, [0.1] * 200), (4, None, early)], "id int, w array<double>, c array<double>")
    out = {r["id"]: r["r"] for r in df.select("id", waveforms.retrack(F.col("w"), waveforms.coherent(F.col("c"))).alias("r")).collect()}
    assert (out[1]["peak"], out[1]["status"]) == (80, "ok") and (out[2]["peak"], out[2]["status"]) == (120, "ok") and out[1]["gate"] < 80 < out[2]["gate"] < 120
    assert (out[3]["status"], out[3]["gate"]) == ("low_coh", None) and out[4]["status"] == "empty"


@pytest.mark.parametrize("few", [0, 50])
def test_block_pairs_as_numpy(spark, monkeypatch, few):
    """Split squares, copies of places and ids, ties among differences and a first edge above 0; pairs don't leave their task."""
    for name, value in (("BLOCK", 16), ("TILE", 64), ("TASK", 500), ("FEW", few)):
        monkeypatch.setattr(spatial, name, value)
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-3, 3, (2, 120))
    x[:40], y[:40], v = 0.25, -0.5, np.round(rng.normal(0, 2, 120), 1)
    ids = [k if k < 110 else 5 for k in range(120)]
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in zip(ids, zip(x, y, v, strict=True), strict=True)] + [(999, None, 1.0, 1.0)], "id long, x double, y double, v double")
    i, j = np.triu_indices(120, 1)
    differ = np.array(ids)[i] != np.array(ids)[j]
    d, dv = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)[differ], np.abs(v[i] - v[j])[differ]
    for edges in ([0.0, 0.5, 1.0, 1.5], [0.3, 1.2]):
        want = {k: dv[(d >= a) & (d < b)] for k, (a, b) in enumerate(itertools.pairwise(edges))}
        for how, gamma in (("matheron", lambda w: (w**2).mean() / 2), ("dowd", lambda w: (1.4826 * np.median(w)) ** 2 / 2)):
            got = {r["bin"]: (r["n"], r["gamma"]) for r in spatial.variogram(p, edges, how, 1).collect()}
            assert got == {k: (len(w), pytest.approx(gamma(w))) for k, w in want.items()}
    assert spatial.variogram(p.limit(0), [0.0, 1.0], "dowd").count() == spatial.variogram(p.limit(0), [0.0, 1.0], "matheron").count() == 0
    model = [("nugget", 0.5, 0.0), ("spherical", 1.0, 2.0)]
    off = (1.5 - spatial.model_value(np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2), model)).mean()
    e = spatial.effective_samples(p, model, None)
    assert e["n_points"] == 121 - 1 and e["mean_offdiag_cov"] == pytest.approx(off, rel=1e-12)
    assert spatial.effective_samples(p.limit(1), model, None)["var_mean"] == 1.5


def test_large_groups_get_medians_by_counts(spark, monkeypatch):
    """Odd and even groups, ties, null keys, far outliers and small groups among large ones, as numpy; the largest list is of LARGE values."""
    monkeypatch.setattr(stats, "LARGE", 20), monkeypatch.setattr(stats, "COUNTERS", 64)
    rng = np.random.default_rng(6)
    groups = {"odd": rng.normal(0, 1, 301), "even": np.append(rng.exponential(1, 299), 1e12), "tied": np.repeat([1.0, 2.0], 40), "same": np.full(50, 3.0), None: rng.normal(5, 2, 80), "few": rng.normal(0, 1, 8), "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None)], "k string, v double").repartition(3)
    got = {r["k"]: (r["n"], r["median"], r["nmad"]) for r in stats.counted_nmad(df, ["k"], "v").collect()}
    assert got == {k: (len(v), pytest.approx(np.median(v), rel=1e-12), pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))), rel=1e-12)) for k, v in groups.items()}
    assert stats.large_medians(df.where("k = 'tied'"), ["k"], "v", [{"k": "tied", "n": 80, "low": 1.0, "high": 2.0}]) == [1.5]
