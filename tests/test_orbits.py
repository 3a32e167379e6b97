"""Orbits, geotransforms, displacements and principal axes against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_an_orbit_passes_over_its_place_and_turns_back_in_time(spark):
    from penumbra.functions import orbits

    inclination, period, radius = math.radians(98.5), 5970.0, 7.1e6
    phi, lam = F.radians(F.lit(41.0)), F.radians(F.lit(-12.0))
    w, node = orbits.node(phi, lam, inclination)

    def place(t):
        return orbits.orbit_position(t, radius, inclination, period, w, node)

    _, lat, lon = orbits.ground_track(F.lit(0.0), period, inclination, w, node)
    speed = orbits.slope(place, F.lit(0.0), 0.01)
    far = orbits.node(F.radians(F.lit(85.0)), lam, inclination)[0]
    columns = {"lat": F.degrees(lat), "lon": F.degrees(lon), "far": far}
    columns |= dict(zip("xyz", place(F.lit(0.0)), strict=True)) | dict(zip("uvw", speed, strict=True))
    got = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    assert (got["lat"], got["lon"]) == pytest.approx((41.0, -12.0)) and got["far"] is None
    position, velocity = np.array([got[c] for c in "xyz"]), np.array([got[c] for c in "uvw"])
    assert np.linalg.norm(position) == pytest.approx(radius)
    # along the circle and with the turning earth, not away from it
    assert abs(position @ velocity) < 1e-3 * np.linalg.norm(position) * np.linalg.norm(velocity)


def test_sights_come_back_from_the_ground(spark):
    from penumbra.functions import geo, orbits

    seen = spark.createDataFrame([(0.0, 0.0, 5.0, 30.0), (45.0, 100.0, 12.0, -170.0), (-60.0, -40.0, 1.0, 90.0)], "lat double, lon double, zn double, az double")
    angles = [F.col(c) for c in ("lat", "lon", "zn", "az")]
    ground, sight = geo.earth_centred(*angles[:2]), orbits.line_of_sight(*angles)
    zenith, azimuth = orbits.acquisition_angles([g + s * 8e5 for g, s in zip(ground, sight, strict=True)], ground)
    for row in seen.select("zn", "az", zenith.alias("zenith"), azimuth.alias("azimuth")).collect():
        assert row["zenith"] == pytest.approx(row["zn"], abs=0.2)
        assert math.sin(math.radians(row["zenith"])) * math.cos(math.radians(row["azimuth"] - row["az"])) == pytest.approx(math.sin(math.radians(row["zn"])), abs=4e-3)
    none = spark.range(1).select(*(c.alias(n) for n, c in zip("xyz", orbits.unit([F.lit(0.0)] * 3), strict=True))).first()
    assert list(none) == [None] * 3


def test_geotransforms_and_rings(spark):
    from penumbra.functions import geo, transforms

    t = (100.0, 10.0, 2.0, 500.0, 1.0, -8.0)
    there = geo.pixel_to_map(t, F.lit(3.0), F.lit(4.0))
    columns = {"x": transforms.shifted(t, 3.0, 4.0)[0], "y": transforms.shifted(t, 3.0, 4.0)[3], "px": there[0], "py": there[1]}
    box = (0.0, 30.0, -10.0, 20.0)
    ring = spark.range(1).select(transforms.box_ring(box).alias("r"), transforms.box_text(box).alias("t"), *(c.alias(n) for n, c in columns.items())).first()
    assert (ring["x"], ring["y"]) == (ring["px"], ring["py"])
    points = [tuple(p) for p in ring["r"]]
    assert points[0] == points[-1] and len(set(points)) == 4
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:], strict=False)) == 2 * 30 * 30
    assert ring["t"] == "POLYGON ((0.0 20.0, 0.0 -10.0, 30.0 -10.0, 30.0 20.0, 0.0 20.0))"


def test_template_samples(spark):
    from penumbra.functions import transforms

    got = spark.range(1).select(transforms.template_points(F.lit(2), ((2.0, 0.5), (0.0, 1.0)), between=True).alias("b"), transforms.turned_template_points(F.lit(1), F.lit(90.0)).alias("t")).first()
    along = np.linspace(-1.5, 1.5, 4)
    x, y = np.meshgrid(along, along)
    assert np.allclose([tuple(p) for p in got["b"]], np.stack((2 * x + 0.5 * y, y), -1).reshape(-1, 2))
    x, y = np.meshgrid([-1, 0, 1], [-1, 0, 1])
    assert np.allclose([tuple(p) for p in got["t"]], np.stack((y, -x), -1).reshape(-1, 2))


def test_first_axes_match_numpy(spark):
    from penumbra.operators import axes

    rng = np.random.default_rng(5)
    rows = []
    for group in range(4):
        mixed = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
        rows += [(group, *map(float, r)) for r in mixed]
    rows += [(7, 1.0, 2.0, 3.0), (8, 1.0, None, 2.0)]
    got = {r["g"]: r for r in axes.first_axis(spark.createDataFrame(rows, "g int, a double, b double, c double"), ["g"], ["a", "b", "c"]).collect()}
    for group in range(4):
        values, vectors = np.linalg.eigh(np.cov(np.array([r[1:] for r in rows if r[0] == group]).T))
        axis = vectors[:, -1] * np.sign(vectors[:, -1].sum())
        assert got[group]["largest"] == pytest.approx(values[-1])
        assert np.allclose([got[group][f"e{k}"] for k in (1, 2, 3)], axis, atol=1e-8)
    assert got[7]["e1"] is None and 8 not in got


def test_fits_of_a_line_are_null_and_masks_without_pixels_are_left_out(spark):
    from penumbra.operators import axes

    pixels = spark.createDataFrame([("a", i, j, 5.0 + 2.0 * j - i, 7.0 - 3.0 * i) for i in range(3) for j in range(4)] + [("b", 1, j, 1.0 * j, 2.0) for j in range(3)], "k string, i int, j int, x double, y double")
    got = {r["k"]: r for r in axes.fitted_transform(pixels, ["k"]).collect()}
    assert list(got["a"])[1:] == pytest.approx([5.0, 2.0, -1.0, 7.0, 0.0, -3.0]) and got["b"]["x0"] is None
    extent = axes.mask_extent(pixels, ["k"], (F.col("j") > 1) & (F.col("k") == "a")).collect()
    assert [tuple(r) for r in extent] == [("a", 0, 2, 2, 3)]


def test_component_indices_match_numpy(spark):
    from penumbra.operators import axes

    bands = [(0.1, 0.2, 0.4), (0.3, 0.5, 0.35), (0.6, 0.1, 0.7), (0.25, 0.45, 0.9), (0.8, 0.7, 0.1)]
    df = spark.createDataFrame([(0, *b) for b in bands], "g int, blue double, green double, red double")
    joined = df.join(axes.first_axis(df, ["g"], ["red", "green", "blue"]), "g")
    blue, green, red = (F.col(c) for c in ("blue", "green", "red"))
    got = joined.select("blue", axes.shadow_detector(blue, green, red).alias("d"), axes.component_shadow(blue, green, red).alias("s")).collect()
    colours = np.array(bands)[:, ::-1]
    _, vectors = np.linalg.eigh(np.cov(colours.T))
    axis = vectors[:, -1] * np.sign(vectors[:, -1].sum())
    want = {b: (2 - np.array([r, g, b]) @ axis) / ((g - b) * r + 1) for b, g, r in bands}
    assert all(row["d"] == pytest.approx(want[row["blue"]]) for row in got)
    assert all(row["s"] is not None for row in got)


def test_displacements_turn_and_project(spark):
    from penumbra.functions import displacements

    turn = displacements.turned(F.lit(1.0), F.lit(0.0), F.lit(90.0))
    flow = displacements.along_flow(F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), 1.0, 0.0)
    none = displacements.along_flow(F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), 1.0, 1.0)[0]
    got = spark.range(1).select(turn[0].alias("u"), turn[1].alias("v"), flow[0].alias("x"), flow[1].alias("y"), none.alias("n")).first()
    assert (got["u"], got["v"], got["x"], got["y"]) == pytest.approx((0.0, 1.0, 2.0, 2.0)) and got["n"] is None


def test_refraction_follows_the_profile_of_its_time(spark):
    from penumbra.operators import photohypsometry

    air = spark.createDataFrame([("a", 0.0, 290.0, 101300.0, 0.5), ("a", 1000.0, 284.0, 90000.0, 0.4), ("b", 0.0, 270.0, 101300.0, 0.1)], "timestamp string, z double, temperature double, pressure double, humidity double")
    rows = spark.createDataFrame([(1, "a", 500.0, 60.0), (2, "a", -5.0, 60.0), (3, "a", 5000.0, 60.0), (4, "c", 0.0, 60.0), (5, "a", None, 60.0), (6, "b", 900.0, 60.0)], "id int, timestamp string, caster_Z double, zenith double")
    for humid in (False, True):
        got = {r["id"]: r["zenith_refrac"] for r in photohypsometry.with_refracted_zenith(rows, air, 0.55, humid).collect()}
        assert got[4] is None and got[5] is None
        # denser air below bends more
        assert 59.9 < got[6] < got[2] < got[1] < got[3] < 60.0
    flat = photohypsometry.with_refracted_zenith(rows, air.filter("z = 0"), 0.55).filter("id in (1, 2, 3)").select("zenith_refrac").distinct()
    assert flat.count() == 1


def test_view_angles_outside_are_zero(spark):
    from penumbra.operators import photohypsometry

    views = spark.createDataFrame([(0, 0, 7.9), (0, 1, -3.7)], "i long, j long, value double")
    rows = spark.createDataFrame([(1, 0.4, 0.2), (2, 0.6, 0.0), (3, 9.0, 9.0)], "id int, caster_X double, caster_Y double")
    out = photohypsometry.with_view_angles(rows, views, views, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    assert {r["id"]: (r["caster_zn"], r["caster_az"]) for r in out.collect()} == {1: (7, 7), 2: (-3, -3), 3: (0, 0)}


def test_orbits_come_back_from_their_sights(spark):
    """Radius, inclination and the times between rows are found; a shift of time along the track is not."""
    from penumbra.functions import orbits
    from penumbra.operators.orbits import fit_orbits

    rng = np.random.default_rng(1)
    truth = {g: (0.7 + 0.05 * g, 0.2 * g, 7.16e6 + 1e4 * g, float(np.radians(98.5 - 0.2 * g)), 6040.0) for g in range(2)}
    seen = [(g, k, *t, float(rng.uniform(-20, 20)), float(rng.uniform(-0.02, 0.02)), float(rng.uniform(-0.02, 0.02))) for g, t in truth.items() for k in range(40)]
    df = spark.createDataFrame(seen, "g long, row_id long, lat double, lon double, radius double, inclination double, period double, time double, a double, b double")
    argument, longitude = orbits.node(F.col("lat"), F.col("lon"), F.col("inclination"))
    place = orbits.orbit_position(F.col("time"), F.col("radius"), F.col("inclination"), F.col("period"), argument, longitude)
    _, lat, lon = orbits.ground_track(F.col("time"), F.col("period"), F.col("inclination"), argument, longitude)
    lat, lon = lat + F.col("a"), lon + F.col("b")
    ground = [F.cos(lat) * F.cos(lon) * 6.371e6, F.cos(lat) * F.sin(lon) * 6.371e6, F.sin(lat) * 6.371e6]
    sight = orbits.unit([p - q for p, q in zip(place, ground, strict=True)])
    rows = df.select("g", "row_id", *(c.alias(f"sight_{x}") for c, x in zip(sight, "xyz", strict=True)), *(c.alias(f"ground_{x}") for c, x in zip(ground, "xyz", strict=True)))
    start = spark.createDataFrame([(g, t[0] + 0.002, t[1] - 0.003, t[2] + 5000, t[3] + 0.001, t[4]) for g, t in truth.items()] + [(9, 0.1, 0.1, 7e6, 1.7, 6000.0)], "g long, lat double, lon double, radius double, inclination double, period double")
    found, times = fit_orbits(rows, ["g"], start, 4)
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == set(truth)
    for g, t in truth.items():
        assert got[g]["n"] == 40 and got[g]["rms"] < 1e-9 and abs(got[g]["radius"] - t[2]) < 1e-2 and abs(got[g]["inclination"] - t[3]) < 1e-9
    found_times = {(r["g"], r["row_id"]): r["time"] for r in times.collect()}
    for g in truth:
        off = [found_times[r[0], r[1]] - r[7] for r in seen if r[0] == g]
        assert max(off) - min(off) < 1e-6
