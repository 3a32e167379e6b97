"""Operators on small tables against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.operators import matching, pairing, photohypsometry, rasters, statistics
from penumbra.sources import conn


def test_elevation_difference(spark):
    z1, z2 = math.degrees(math.atan(3 / 4)), math.degrees(math.atan(4 / 3))
    args = [(0, 3, z1, 0, 4, z2, 0, 0), (0, 4, z2, 0, 3, z1, 0, 0)]
    df = spark.createDataFrame([tuple(map(float, a)) for a in args], "x1 double, y1 double, n1 double, x2 double, y2 double, n2 double, xt double, yt double")
    got = [r[0] for r in df.select(photohypsometry.elevation_difference(*(F.col(c) for c in df.columns))).collect()]
    assert got == pytest.approx([1.0, -1.0])


def test_one_by_one_pairing(spark):
    rng = np.random.default_rng(3)
    left, right = rng.random((60, 2)) * 20, rng.random((40, 2)) * 20
    frame = lambda pts: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "id long, x double, y double")
    free, want = set(range(60)), {}
    for k, p in enumerate(right):
        near = sorted((((left[m] - p) ** 2).sum(), m) for m in free)
        if near and near[0][0] < 4:
            want[k] = near[0][1]
            free.discard(near[0][1])
    got = pairing.one_to_one(frame(left), frame(right), 4.0)
    assert {r["id_2"]: r["id_1"] for r in got.collect()} == want


def test_crowded_posts_pair_and_meet_as_one_by_one(spark, monkeypatch):
    """Copies of one place, ties, a dense spot and lone posts; lists and batches so short that they go on."""
    rng = np.random.default_rng(5)
    spots = [(30.0, 30.0)] * 40 + [tuple(p) for p in 40 + rng.random((60, 2)) * 0.01] + [tuple(p) for p in np.floor(rng.random((80, 2)) * 30)] + [(500.0, 500.0), (-0.0, 0.0), (0.0, -0.0)]
    posts = [(int(k), float(x), float(y)) for k, (x, y) in zip(rng.permutation(len(spots)), spots, strict=True)]
    frame = lambda rows: spark.createDataFrame(rows + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, x double, y double")
    d2 = lambda a, b: (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])

    edges = set()
    for a in posts:
        near = sorted((d2(a, b), b[0]) for b in posts if b[0] != a[0] and d2(a, b) < 25)[:4]
        edges |= {(a[0], b, k + 1) for k, (_, b) in enumerate(near)}
    assert {tuple(r) for r in pairing.neighbour_graph(frame(posts), 4, 5.0).collect()} == edges

    left, right = posts[::2], posts[1::2]
    best = {b[0]: min(near)[1] for b in right if (near := [(d2(a, b), a[0]) for a in left if d2(a, b) < 25])}
    assert {r["id_2"]: r["id_1"] for r in pairing.nearest(frame(left), frame(right), 5.0).collect()} == best

    asked = []
    found = pairing._nearest
    monkeypatch.setattr(pairing, "_nearest", lambda left, wanted, most, reach: asked.append(most) or found(left, wanted, most, reach))
    monkeypatch.setattr(pairing, "WISHES", 2)
    monkeypatch.setattr(pairing, "LOOKS", 1)
    free, want = {a[0]: a for a in left}, {}
    for b in sorted(right):
        near = sorted((d2(a, b), a[0]) for a in free.values() if d2(a, b) < 25)
        if near:
            want[b[0]] = near[0][1]
            del free[near[0][1]]
    assert {r["id_2"]: r["id_1"] for r in pairing.one_to_one(frame(left), frame(right), 25.0).collect()} == want
    assert asked.count(2) > 1 and max(asked) > 2


def test_numbers_are_dense(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 501).alias("a"))
    got = {r["a"]: r["n"] for r in pairing.numbered(rows, ["a"], "n").collect()}
    assert [got[a] for a in sorted(got)] == list(range(1, 501))


def test_pairs_of_a_group(spark):
    df = spark.createDataFrame([(1, k) for k in range(6)] + [(2, 0)], "g int, t int")
    got = pairing.ordered_pairs(df, "g", ["t"], ["t"]).collect()
    assert len(got) == 15 and all(r["t_1"] < r["t_2"] for r in got)


def plane(spark, rows=7, cols=6, f=lambda i, j: 2.0 * i + 3.0 * j):
    return spark.createDataFrame([("r", i, j, float(f(i, j))) for i in range(rows) for j in range(cols)], "raster_id string, i long, j long, value double")


def test_gradients_and_curvature_of_a_plane(spark):
    for r in rasters.slopes(plane(spark), 1.0).collect():
        inside = 0 < r["i"] < 6 and 0 < r["j"] < 5
        assert (r["down"] is not None) == inside
        if inside:
            assert r["down"] == pytest.approx(2.0) and r["right"] == pytest.approx(3.0)
    flat = rasters.curvature(plane(spark)).filter("curvature IS NOT NULL").collect()
    assert len(flat) == 20 and all(abs(r["curvature"]) < 1e-9 for r in flat)


@pytest.mark.parametrize("border", ["clamp", "mirror"])
def test_bilinear_on_a_plane(spark, border):
    points = spark.createDataFrame([(1, 2.25, -3.5), (2, 0.0, 0.0), (3, -0.5, -1.0)], "id int, x double, y double")
    got = {r["id"]: r["z"] for r in rasters.sample_bilinear(points, plane(spark), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), (7, 6), "x", "y", "z", "id", border).collect()}
    assert got[1] == pytest.approx(2 * 3.5 + 3 * 2.25) and got[2] == 0
    assert got[3] == pytest.approx(2.0 if border == "clamp" else 2 + 1.5)


def test_fill_and_filter(spark):
    holes = plane(spark).withColumn("value", F.when((F.col("i") == 3) & (F.col("j") == 3), None).otherwise(F.col("value")))
    got = rasters.local_fill(holes, 1).filter("i = 3 AND j = 3").first()
    assert got["value"] == pytest.approx(2 * 3 + 3 * 3)
    spiked = plane(spark).withColumn("value", F.when((F.col("i") == 3) & (F.col("j") == 3), 999.0).otherwise(F.col("value")))
    assert not rasters.local_median_filter(spiked, 1).filter("i = 3 AND j = 3").first()["inlier"]


def test_shadow_behind_a_wall(spark):
    wall = plane(spark, 8, 1, lambda i, j: 25.0 if i == 2 else 0.0)
    got = [r["i"] for r in rasters.shadow_cast(wall, 45.0).filter("shadow").orderBy("i").collect()]
    assert got == [3, 4]
    assert [(r["first"], r["last"]) for r in rasters.shadow_runs(rasters.shadow_cast(wall, 45.0)).collect()] == [(3, 4)]


def test_mass_balance_recovers_rates(spark):
    rows = [(f"{y}-10-01", f"{y + s}-09-30", 50.0, -0.5 * s) for y in range(2000, 2004) for s in (1, 2) if y + s <= 2004]
    df = spark.createDataFrame(rows, "a string, b string, z_12 double, dz_12 double").select(F.to_date("a").alias("t_1"), F.to_date("b").alias("t_2"), "z_12", "dz_12")
    got = {r["year"]: r["rate"] for r in photohypsometry.mass_balance(df, 2001, 2004).collect()}
    assert got == pytest.approx({y: -0.5 for y in range(2001, 2005)}, abs=0.01)


@pytest.mark.parametrize("code", sorted(matching.CORRELATORS))
def test_correlators_find_a_shift(code):
    rng = np.random.default_rng(8)
    big = rng.standard_normal((32, 32))
    f = np.fft.fft2(big) * np.exp(-((np.fft.fftfreq(32)[:, None] ** 2 + np.fft.fftfreq(32)[None] ** 2) * 60))
    a = np.real(np.fft.ifft2(f))
    got = matching.locate(a, np.roll(a, (3, -5), (0, 1)), code, None)
    assert (got["di"], got["dj"]) == (3, -5)


def test_steady_state_of_a_constant(spark):
    df = spark.createDataFrame([([5.0] * 4,), ([1.0, 9.0, 1.0, 9.0],)], "s array<double>")
    flat, rough = (r[0] for r in df.select(statistics.steady_state(F.col("s"))).collect())
    assert flat is None and rough > 0


def test_fit_of_a_sine(spark):
    df = spark.range(360).select(F.col("id").cast("double").alias("a"), (F.sin(F.radians(F.col("id") + 30)) * 4 + 2).alias("v"))
    assert statistics.fit_sinus(df, "a", "v") == pytest.approx((30.0, 4.0, 2.0))


def test_connection_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-02", 1.25, None, 7), ("2021-03-04", -3.5, 2.75, None)], "timestamp string, caster_X double, caster_Y double, caster_id int").withColumn("timestamp", F.to_date("timestamp"))
    path = conn.write(df, f"file://{tmp_path}/conn")
    got = conn.read(spark, path).orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.orderBy("timestamp").collect()]


def test_observations_that_share_two_epochs_are_one_pair(spark):
    df = spark.createDataFrame([(1, 7, 10, 20), (2, 7, 10, 20), (3, 7, 20, 10), (4, 8, 10, 20), (5, 7, 20, 30), (2, 8, 10, 11), (6, 7, None, 30), (None, 7, 10, 20), (1, 8, 11, 20)], "obs_id int, g int, t_1 int, t_2 int")
    out = photohypsometry.temporal_covariance(df, ["g"])
    got = sorted((r["obs_1"], r["obs_2"]) for r in out.collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 5), (5, 6)]
    # pairs are made distinct without a shuffle of their own
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
