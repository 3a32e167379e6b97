"""Spectral weights and peaks between cells against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("rows,columns", [(8, 11), (7, 6)])
def test_windows_match_numpy(spark, rows, columns):
    from penumbra.functions import tapers

    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))
    at = (F.col("i"), F.col("j"), rows, columns)
    along = {"hanning": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "kaiser": lambda n: np.kaiser(n, 14.0)}
    got = cells.select("i", "j", *(getattr(tapers, f"{k}_window")(*at).alias(k) for k in along)).toPandas()
    for name, of in along.items():
        want = np.fft.fftshift(np.sqrt(np.maximum(np.outer(of(rows), of(columns)), 0)))
        assert np.allclose(want[got["i"], got["j"]], got[name], atol=1e-7), name


def test_weights_follow_the_radius_and_one_cell_has_no_frequency(spark):
    from penumbra.functions import tapers

    cells = spark.range(81).select(F.floor(F.col("id") / 9).alias("i"), (F.col("id") % 9).alias("j"))
    at = (F.col("i"), F.col("j"), 9, 9)
    x, y = tapers.fourier_grid(*at)
    got = cells.select("i", "j", x.alias("x"), y.alias("y"), tapers.raised_cosine(*at).alias("w"), tapers.high_pass_circle(*at, r=0.3).alias("high"), tapers.low_pass_circle(*at, r=0.3).alias("low")).toPandas()
    radius = np.hypot(got["x"], got["y"])
    assert (got["w"][radius < 0.149] == 1).all() and (got["w"][radius > 0.5] == 0).all()
    assert ((radius >= 0.3) == (got["high"] == 1)).all()
    assert got.set_index(["i", "j"])["low"][(4, 4)] == 1 and got.set_index(["i", "j"])["low"][(0, 0)] == 0
    one = spark.range(1).select(*(c.alias(n) for n, c in zip("xy", tapers.fourier_grid(F.lit(0), F.lit(0), 1, 1), strict=True)), tapers.kaiser_window(F.lit(0), F.lit(0), 1, 1).alias("w")).first()
    assert (one["x"], one["y"], one["w"]) == (0.0, 0.0, 1.0)


def test_bell_curves_are_found_where_they_stand(spark):
    from penumbra.functions import peaks

    def bell(i, j, at=(0.2, -0.3)):
        return float(np.exp(-((i - at[0]) ** 2) - 0.5 * (j - at[1]) ** 2 - 0.1 * (i - at[0]) * (j - at[1])))

    scores = [[F.lit(bell(a, b)) for b in (-1, 0, 1)] for a in (-1, 0, 1)]
    i, j = peaks.gaussian_surface(scores)
    line = [F.lit(float(np.exp(-((k - 0.25) ** 2)))) for k in (-1, 0, 1)]
    curve = [F.lit(4.0 - (k - 0.25) ** 2) for k in (-1, 0, 1)]
    got = spark.range(1).select(i.alias("i"), j.alias("j"), peaks.gaussian(*line).alias("line"), peaks.parabolic(*curve).alias("curve"), peaks.parabolic(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("flat"), peaks.gaussian(F.lit(-1.0), F.lit(1.0), F.lit(0.5)).alias("none")).first()
    assert (got["i"], got["j"], got["line"], got["curve"]) == pytest.approx((0.2, -0.3, 0.25, 0.25))
    assert got["flat"] is None and got["none"] is None


def test_tops_of_bowls_and_crossings(spark):
    """The top of a bowl comes back from its scores; a slope crosses zero at the middle of a bell."""
    from penumbra.functions import peaks

    rows = []
    for k, (i0, j0, twist) in enumerate([(0.2, -0.3, 0.0), (-0.1, 0.25, 0.4), (0.3, 0.3, -0.5)]):
        scores = [float(5 - 1.5 * (a - i0) ** 2 - 2.0 * (b - j0) ** 2 + twist * (a - i0) * (b - j0)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        bell = [float(np.exp(-((a - i0) ** 2) / 8)) for a in range(-3, 4)]
        rows.append((k, i0, j0, scores, bell))
    df = spark.createDataFrame(rows, "k long, i0 double, j0 double, s array<double>, b array<double>")
    bowl = peaks.paraboloid([[F.get("s", F.lit(3 * a + b)) for b in range(3)] for a in range(3)])
    crossing = peaks.gradient_crossing([F.get("b", F.lit(a)) for a in range(7)])
    for r in df.select("i0", "j0", bowl[0].alias("i"), bowl[1].alias("j"), crossing.alias("c")).collect():
        assert abs(r["i"] - r["i0"]) < 1e-9 and abs(r["j"] - r["j0"]) < 1e-9 and abs(r["c"] - r["i0"]) < 0.02


def test_least_entropy_takes_the_light_out(spark):
    """Four materials under changing light: the direction of least entropy lies across the direction of light."""
    from penumbra.operators.entropy import least_entropy, shade_free

    rng = np.random.default_rng(5)
    light = np.array([np.cos(np.radians(40)), np.sin(np.radians(40))])
    rows = []
    for g in ("a", None):
        for m in range(4):
            for t in rng.uniform(-2, 2, 300):
                p = t * light + m * 0.8 * np.array([-light[1], light[0]]) + rng.normal(0, 0.01, 2)
                rows.append((g, float(p[0]), float(p[1])))
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    best = {r["g"]: r["direction"] for r in least_entropy(df, ["g"], "x", "y").collect()}
    assert abs(best["a"] - 130) <= 3 and abs(best[None] - 130) <= 3 and best["b"] == 0
    out = shade_free(df, ["g"], "x", "y")
    assert out.columns == ["g", "x", "y", "shadow", "reflectance"] and out.count() == len(rows) + 2
    assert least_entropy(df.limit(0), ["g"], "x", "y").count() == 0


def test_sampling_tells_rasters_apart(spark):
    from penumbra.operators import rasters

    pixels = spark.createDataFrame([(r, i, j, float(k * 100 + 10 * i + j)) for k, r in enumerate("ab") for i in range(3) for j in range(3)], "raster_id string, i long, j long, value double")
    points = spark.createDataFrame([(1, "a", 1.0, -1.0), (2, "b", 1.5, -0.5), (3, "c", 1.0, -1.0)], "id long, raster string, x double, y double")
    t = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    near = rasters.sample_nearest(points, pixels, t, "x", "y", "z", None, raster="raster")
    assert sorted(tuple(r) for r in near.select("id", "z").collect()) == [(1, 11.0), (2, 102.0), (3, None)]
    smooth = rasters.sample_bilinear(points, pixels, t, (3, 3), "x", "y", "z", "id", raster="raster")
    assert sorted(tuple(r) for r in smooth.select("id", "z").collect()) == [(1, 11.0), (2, 106.5), (3, None)]


def test_pixels_of_equal_values_are_turned_once(spark):
    from penumbra.operators.entropy import direction_entropies

    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7 / 7.0).alias("x"), (F.col("id") % 5 / 5.0).alias("y"))
    plan = direction_entropies(df, ["g"], "x", "y", 4)._jdf.queryExecution().optimizedPlan().toString()
    # directions are dealt out above a count of equal values
    dealt = plan[plan.index("explode"):]
    assert dealt.index("count(1) AS one") < dealt.index("var_pop") if "var_pop" in dealt else "count(1) AS one" in dealt
