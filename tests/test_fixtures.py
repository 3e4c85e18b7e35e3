"""Closed forms: shelves with known rates, recovered offsets, edges of rules."""

import numpy as np
import pytest

from cellflow.operators import budget, grid, joins, qc, solvers, stats
from cellflow.operators.store import keep

YEAR = 86400 * 365.25


def shelf(spark, n=24, step=250.0):
    ys, xs = np.mgrid[0:n, 0:n]
    h = 300 - 0.005 * xs * step
    z = h * (1027 - 918) / 1027
    cells = [(int(y), int(x), k * YEAR / 2, float(z[y, x])) for k in range(5) for y in range(n) for x in range(n)]
    return h, spark.createDataFrame(cells, "iy int, ix int, t double, z double"), spark.createDataFrame([(int(y), int(x), 200.0, 0.0, 0.0) for y in range(n) for x in range(n)], "iy int, ix int, vx double, vy double, a_dot double")


def test_eulerian_steady_shelf(spark):
    _, cells, g = shelf(spark)
    out = budget.eulerian(cells, g, 250.0).toPandas()
    assert np.allclose(out["rate"], -1.0, atol=0.01)


def test_lagrangian_steady_shelf(spark):
    h, _, _ = shelf(spark, 40)
    flat = lambda a: [float(x) for x in np.asarray(a).ravel()]
    one = np.ones_like(h)
    starts = spark.createDataFrame([(0, flat(h), flat(200 * one), flat(0 * one), flat(0 * one), flat(0 * one), [(1.5, flat(h)), (2.0, flat(h))])], "start long, H0 array<double>, vx array<double>, vy array<double>, div array<double>, a_dot array<double>, partners array<struct<dt: double, H1: array<double>>>")
    out = budget.pair_median(budget.lagrangian(starts, (40, 40), 250.0)).toPandas()
    assert abs(out["rate"].median() + 1.0) < 0.05


def test_trend_needs_three(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", YEAR, 3.0), ("b", 0.0, 1.0), ("b", YEAR, 2.0), ("b", 2 * YEAR, 3.0), ("c", 5.0, 1.0), ("c", 5.0, 2.0), ("c", 5.0, None)], "k string, t double, z double")
    out = {r.k: r for r in stats.trend(df, ["k"]).collect()}
    assert out["a"].slope is None and abs(out["b"].slope - 1) < 1e-9 and out["b"].rmse < 1e-9 and out["c"].slope is None


def test_robust_trend_ignores_blunder(spark):
    rows = [(c, k * YEAR, c + 2.0 * k + (0.01 * ((k * 7 + c) % 5)) + (50.0 if c == 1 and k == 4 else 0.0)) for c in range(5) for k in range(9)]
    out = {r.k: r.slope for r in stats.robust_trend(spark.createDataFrame(rows, "k int, t double, z double"), ["k"], keep).collect()}
    assert all(abs(s - 2) < 0.05 for s in out.values())


def test_epoch_offsets_recovered(spark):
    off = [0.5, -0.3, 0.1, -0.3]
    rows = [(c, k, float(k), 10.0 * c + 0.7 * (c % 3) * k + off[k]) for c in range(40) for k in range(4)]
    _, got = solvers.epoch_offsets(spark.createDataFrame(rows, "cell int, epoch int, t double, z double"), keep, rounds=8)
    got = {r.epoch: r.offset for r in got.collect()}
    # A common trend of the offsets is one with the cells' trends; what is left of them is recovered.
    a = np.array([got[k] for k in range(4)]) - np.array(off)
    assert np.abs(a - np.polyval(np.polyfit(range(4), a, 1), range(4))).max() < 0.02


def test_epoch_offsets_are_the_optimum(spark):
    rng = np.random.default_rng(8)
    rows = [(c, int(k), float(k + rng.random()), float(rng.normal() + 0.3 * c + 0.2 * k)) for c in range(12) for k in rng.choice(9, 5, replace=False)]
    trend, got = solvers.epoch_offsets(spark.createDataFrame(rows, "cell int, epoch int, t double, z double"), keep)
    t0 = np.mean([r[2] for r in rows])
    mid = {c: np.median([r[3] for r in rows if r[0] == c]) for c in range(12)}
    a, z = np.zeros((len(rows), 33)), np.array([r[3] - mid[r[0]] for r in rows])
    for i, (c, k, t, _) in enumerate(rows):
        a[i, c], a[i, 12 + c], a[i, 24 + k] = 1, t - t0, 1
    x = np.linalg.solve(a.T @ a + np.diag([1e-6] * 24 + [1e-3] * 9), a.T @ z)
    want = x[24:] - x[24:].mean()
    assert all(abs(r.offset - want[r.epoch]) < 1e-6 for r in got.collect()) and all(abs(r.slope - x[12 + r.cell]) < 1e-6 for r in trend.collect())


def test_kmeans_as_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3)) * [1.0, 50.0, 0.1] + rng.integers(0, 3, (400, 1)) * [1.0, 40.0, 0.2]
    got = {r.id: r.cluster for r in solvers.kmeans(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v", 4).collect()}
    z = (x - x.mean(0)) / x.std(0)
    axis = np.ones(3) / np.sqrt(3)
    for _ in range(100):
        axis = np.cov(z.T) @ axis
        axis /= np.linalg.norm(axis)
    p = z @ axis
    centres, last, rounds = np.stack([z[np.argmin(np.abs(p - q))] for q in np.quantile(p, (np.arange(4) + 0.5) / 4)]), None, 0
    for rounds in range(40):
        label = ((z[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        if last is not None and (label == last).all():
            break
        last, centres = label, np.stack([z[label == b].mean(0) for b in range(4)])
    assert rounds > 4 and [got[i] for i in range(400)] == label.tolist()


def test_farthest_seeds_reach_a_small_patch(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.01, (300, 2)), [[5.0, 5.0], [5.01, 5.0], [-4.0, 6.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {r.id: r.cluster for r in solvers.kmeans(df, "id", "v", 3, seeds="farthest").collect()}
    assert len({got[i] for i in range(300)}) == 1 and got[300] == got[301] and len({got[0], got[300], got[302]}) == 3
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id int, v array<double>")
    assert {r.cluster for r in solvers.kmeans(one, "id", "v", 3, seeds="farthest").collect()} == {0}


def test_greedy_dedup_rules(spark):
    p = spark.createDataFrame([(1, 2, 0.9, 0.1, 0.2), (2, 3, 0.8, 0.1, 0.1), (3, 4, 0.7, 0.3, 0.3), (5, 6, 0.6, None, 0.1)], "i int, j int, overlap double, sigma_i double, sigma_j double")
    assert qc.greedy_dedup(p) == [2, 4, 6]


def test_ceiling_is_not_nearest(spark):
    g = spark.createDataFrame([(y, x, 10.0 * y + x) for y in range(4) for x in range(4)], "iy int, ix int, v double")
    p = spark.createDataFrame([(1, 1.2, 2.5)], "id int, fy double, fx double")
    assert grid.gather_index(p, g, "v").first().value == 12.0 and grid.gather_index(p, g, "v", "ceiling").first().value == 23.0
    assert abs(grid.gather_bilinear(p, g, "v").first().value - 14.5) < 1e-9


def test_interpolation_clamps(spark):
    r = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 3.0)], "k int, t double, v double")
    at = spark.createDataFrame([(1, 1, -5.0), (1, 2, 5.0), (1, 3, 50.0), (2, 4, 1.0)], "k int, id int, t double")
    assert {x.id: x.v for x in joins.interpolate_at(at, r, "k").collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 4: None}


def test_overlaps_make_few_other_pairs(spark, monkeypatch):
    """Pairs as by two loops (ends that touch, alike, backwards, days long, null), over dealt nodes; not all intervals of a day are compared."""
    monkeypatch.setattr(joins, "TASK", 40)
    rng = np.random.default_rng(3)
    made = lambda n: [(k, int(t), int(t + d)) for k, (t, d) in enumerate(zip(rng.integers(0, 86400, n), rng.choice([0, 60, 300, 40_000, 900_000, -70], n)))]
    sides = [[*made(90), (900, 600, 900), (901, 600, 900), (902, -500_000, 2_000_000), (903, 40, None)], [*made(80), (900, 900, 1200), (901, 300, 600), (902, None, 50)]]
    for kind in ("timestamp", "timestamp_ntz"):
        frames = [spark.createDataFrame(r, "id long, x long, y long").selectExpr("id", f"cast(timestamp_seconds(x) as {kind}) as t0", f"cast(timestamp_seconds(y) as {kind}) as t1") for r in sides]
        got = sorted(tuple(r) for r in joins.overlaps(*frames, 1).collect())
        full = [[r for r in side if None not in r] for side in sides]
        assert got == sorted((i, j) for i, a0, a1 in full[0] for j, b0, b1 in full[1] if a0 <= b1 and b0 <= a1), kind
    # 300 minutes of a day on each side, none of which meet.
    apart = [spark.range(300).selectExpr("id", f"timestamp_seconds(id * 288 + {at}) as t0", f"timestamp_seconds(id * 288 + {at} + 60) as t1") for at in (0, 100)]
    tables = []
    monkeypatch.setattr(joins, "keep", lambda df: (tables.append(keep(df)), tables[-1])[1])
    assert joins.overlaps(*apart, 1).count() == 0
    work = [df.agg(joins.F.sum("work")).first()[0] or 0 for df in tables if "work" in df.columns]
    assert len(work) == 2 and sum(work) < 300 * 300 / 20
    f = joins._nodes(joins.F.col("x"), joins.F.col("y"), 3)
    for x, y in ((0, 0), (3, 2), (-5, 70), (1, 300)):
        nodes = spark.sql(f"select {x}L as x, {y}L as y").select(f.alias("n")).first()["n"]
        leaves = [r["node"] * 4 ** r["level"] + j for r in nodes for j in range(4 ** r["level"])]
        assert sorted(leaves) == list(range(x, y + 1)) and len(nodes) < 25
    assert joins.overlaps(frames[0].limit(0), frames[1], 1).count() == 0


def test_overlaps_in_tiles_and_runs(spark, monkeypatch, tmp_path):
    """Whatever the tiles and runs, the same pairs (rows alike and null ids too); many that overlap many take little room in files."""
    rng = np.random.default_rng(4)
    sides = [[(None if k == 7 else k // 2, int(t), int(t + d)) for k, (t, d) in enumerate(zip(rng.integers(0, 20_000, 120), rng.choice([0, 300, 15_000, 90_000], 120)))] * 2 for _ in "ab"]
    frames = [spark.createDataFrame(r, "id long, x long, y long").selectExpr("id", "timestamp_seconds(x) as t0", "timestamp_seconds(y) as t1") for r in sides]
    order = lambda r: sorted(r, key=lambda x: [-1 if v is None else v for v in x])
    full = order((i, j) for i, a0, a1 in sides[0] for j, b0, b1 in sides[1] if a0 <= b1 and b0 <= a1)
    for side, run, task in ((5, 3, 200), (16, 128, 10**6)):
        for name, v in (("SIDE", side), ("RUN", run), ("TASK", task)):
            monkeypatch.setattr(joins, name, v)
        assert order(tuple(r) for r in joins.overlaps(*frames, 1).collect()) == full, (side, run)
    monkeypatch.undo()
    monkeypatch.setattr(joins, "TASK", 2_000_000)
    few, many = (spark.range(n).selectExpr("hash(id) * 100L as id", f"timestamp_seconds({at} + id * {step}) as t0", f"timestamp_seconds({at} + id * {step} + 40000) as t1") for n, at, step in ((300, 30_000, 20), (20_000, 0, 1)))
    for a, b in ((few, many), (many, few)):
        joins.overlaps(a, b, 1).write.parquet(out := str(tmp_path / f"{a is few}"))
        assert spark.read.parquet(out).count() == 300 * 20_000
        assert sum(f.stat().st_size for f in (tmp_path / f"{a is few}").glob("*.parquet")) < 0.5 * 300 * 20_000


def test_readers(spark, tmp_path):
    from cellflow.sources import readers

    (tmp_path / "c.csv").write_text("easting,northing,h_mean\n# note\n1,2,3\n4,5,6\n")
    (tmp_path / "w.txt").write_text("# x y\n1 2 3\n 4  5 6\nbad line\n")
    (tmp_path / "l.txt").write_text("x\nTranslation vector (North-East-Down, meters): Vector3(1.5,-2,3e-1)\n")
    assert readers.control_csv(spark, str(tmp_path / "c.csv")).count() == 2
    assert [tuple(r) for r in readers.whitespace_table(spark, str(tmp_path / "w.txt"), ["a", "b", "c"]).orderBy("a").collect()] == [(1, 2, 3), (4, 5, 6)]
    r = readers.log_vector(spark, str(tmp_path / "l.txt")).first()
    assert (r.dn, r.de, r.dd) == (1.5, -2.0, 0.3)


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="z"):
        stats.trend(spark.createDataFrame([(1, 2.0)], "k int, t double"), ["k"])
